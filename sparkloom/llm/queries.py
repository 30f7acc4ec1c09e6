"""Queries and SQL of the training-data operators, for __spark_entry__.py."""

from .decontamination import op3_decontamination
from .language_id import op10_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .near_dedup import OP4_SQL, op4_near_dedup
from .nearest import op8_nearest
from .packing import op1_packing
from .resharding import op7_resharding
from .secret_scan import OP2_SQL, op2_secret_scan
from .surrogates import op5_surrogates
from .token_counts import op6_token_counts
from .toxicity import op12_toxicity
from .txlog import op11_txlog
from .vector_codes import OP13_SQL, op13_vector_codes

_ALL = (op1_packing, op2_secret_scan, op3_decontamination, op4_near_dedup, op5_surrogates, op6_token_counts, op7_resharding, op8_nearest, op9_line_dedup, op10_language_id, op11_txlog, op12_toxicity, op13_vector_codes)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op2_secret_scan": OP2_SQL, "op4_near_dedup": OP4_SQL, "op9_line_dedup": OP9_SQL, "op13_vector_codes": OP13_SQL}
