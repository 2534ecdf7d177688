"""The queries of this subpackage and their SQL."""

from . import sql
from .decontamination import op9_decontamination
from .fm_index import op3_substring_dedup
from .language_id import op7_language_id
from .line_dedup import OP4_SQL, op4_line_dedup
from .merkle import op11_merkle_manifest
from .nearest import op8_nearest
from .ngram_join import op2_ngram_jaccard
from .packing import op5_packing
from .phrases import op13_collocations
from .sharding import op1_sharding
from .suffix_merge import op10_suffix_array_dedup
from .token_ids import op6_token_ids
from .wrapper import op12_main_text

QUERIES = {f.__name__: f for f in (op1_sharding, op2_ngram_jaccard, op3_substring_dedup, op4_line_dedup, op5_packing, op6_token_ids, op7_language_id, op8_nearest, op9_decontamination, op10_suffix_array_dedup, op11_merkle_manifest, op12_main_text, op13_collocations)}

ORACLES: dict[str, str] = {"op2_ngram_jaccard": sql.OP2, "op3_substring_dedup": sql.OP3, "op4_line_dedup": OP4_SQL, "op10_suffix_array_dedup": sql.OP10, "op11_merkle_manifest": sql.OP11, "op13_collocations": sql.OP13}
