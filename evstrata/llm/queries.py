"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP10_SQL, op10_perspective_rotation
from .decontaminate import op6_spaced_seed_decontamination
from .language import op3_kneser_ney_language
from .licences import op4_licence_classifier
from .near_dup import op5_hyperminhash_neardup
from .packing import op8_martello_toth_packing
from .quality import op7_weak_supervision
from .token_counts import op2_count_only_viterbi
from .urls import OP9_SQL, op9_rarest_token_urls
from .warc import OP1_SQL, op1_warc_boundary_chain

QUERIES = {
    "op1_warc_boundary_chain": op1_warc_boundary_chain,
    "op2_count_only_viterbi": op2_count_only_viterbi,
    "op3_kneser_ney_language": op3_kneser_ney_language,
    "op4_licence_classifier": op4_licence_classifier,
    "op5_hyperminhash_neardup": op5_hyperminhash_neardup,
    "op6_spaced_seed_decontamination": op6_spaced_seed_decontamination,
    "op7_weak_supervision": op7_weak_supervision,
    "op8_martello_toth_packing": op8_martello_toth_packing,
    "op9_rarest_token_urls": op9_rarest_token_urls,
    "op10_perspective_rotation": op10_perspective_rotation,
}

ORACLES = {"op1_warc_boundary_chain": OP1_SQL, "op9_rarest_token_urls": OP9_SQL, "op10_perspective_rotation": OP10_SQL}
