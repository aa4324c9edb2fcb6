"""The queries of this package, by name."""

from __future__ import annotations

from . import oracle
from .bpe import op8_bpe
from .html_render import op4_html_render
from .importance import op13_importance_resampling
from .license_scan import op7_license_scan
from .line_dedup import op11_line_dedup
from .ngram_join import op2_ngram_join
from .packing import op9_packing
from .quality import op5_quality
from .secrets_scan import op1_secret_scan
from .sharding import op10_sharding
from .topk import op6_topk
from .warc import op3_warc
from .whitening import op12_whitening

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_ngram_join": op2_ngram_join,
    "op3_warc": op3_warc,
    "op4_html_render": op4_html_render,
    "op5_quality": op5_quality,
    "op6_topk": op6_topk,
    "op7_license_scan": op7_license_scan,
    "op8_bpe": op8_bpe,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
    "op11_line_dedup": op11_line_dedup,
    "op12_whitening": op12_whitening,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE = {
    "op2_ngram_join": oracle.NGRAM_JOIN,
    "op3_warc": oracle.WARC,
    "op6_topk": oracle.TOP_K,
    "op7_license_scan": oracle.LICENSES,
    "op11_line_dedup": oracle.LINE_DEDUP,
    "op13_importance_resampling": oracle.RESAMPLE,
}
