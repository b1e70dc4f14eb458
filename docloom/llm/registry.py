"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from .alignment import op11_tokenizer_alignment
from .bpe import op1_bpe
from .chat import SQL_OP8, op8_chat_formatting
from .decontaminate import op2_decontamination
from .divergence import SQL_OP12, op12_source_divergence
from .html_extract import op6_html_extraction
from .licenses import op9_license_scan
from .pii import op4_pii
from .quality import SQL_OP7, op7_quality_rules
from .secret_scan import SQL_OP13, op13_secret_scan
from .simhash import op3_simhash_dedup
from .suffix_dedup import op10_suffix_dedup
from .toxicity import op5_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality_rules": op7_quality_rules,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_license_scan": op9_license_scan,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_source_divergence": op12_source_divergence,
    "op13_secret_scan": op13_secret_scan,
}
SQL = {
    "op7_quality_rules": SQL_OP7,
    "op8_chat_formatting": SQL_OP8,
    "op12_source_divergence": SQL_OP12,
    "op13_secret_scan": SQL_OP13,
}
