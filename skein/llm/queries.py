"""The queries of this subpackage. None has SQL: each is tested against brute force, a round trip or held-out labels."""

from __future__ import annotations

from .html import op1_html
from .idfile import op4_token_ids
from .jaccard import op5_jaccard
from .media import op3_media
from .packing import op9_packing
from .pieces import op2_pieces
from .pii import op10_pii
from .quality import op7_quality
from .search import op6_search
from .toxicity import op8_toxicity

QUERIES = {
    "op1_html": op1_html,
    "op2_pieces": op2_pieces,
    "op3_media": op3_media,
    "op4_token_ids": op4_token_ids,
    "op5_jaccard": op5_jaccard,
    "op6_search": op6_search,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
}
ORACLES: dict[str, str] = {}
