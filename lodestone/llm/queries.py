"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op7
from .codes import SQL12, op12
from .common import table
from .htmltext import op4
from .langid import op13
from .lm import op8
from .media import op10
from .mixing import SQL3, op3
from .neardup import op5
from .quality import op2
from .toxicity import op9
from .vectors import op6
from .warc import SQL1, op1
from .whitening import op11


def queries() -> dict:
    return {
        "op1_warc": lambda spark, d: op1(table(spark, d, "pages")),
        "op2_quality": lambda spark, d: op2(table(spark, d, "documents"), table(spark, d, "labels")),
        "op3_mixing": lambda spark, d: op3(table(spark, d, "documents")),
        "op4_html": lambda spark, d: op4(table(spark, d, "pages")),
        "op5_minhash": lambda spark, d: op5(table(spark, d, "documents")),
        "op6_vectors": lambda spark, d: op6(table(spark, d, "embeddings")),
        "op7_bpe": lambda spark, d: op7(table(spark, d, "documents")),
        "op8_lm": lambda spark, d: op8(table(spark, d, "documents")),
        "op9_toxicity": lambda spark, d: op9(table(spark, d, "documents"), table(spark, d, "labels")),
        "op10_media": lambda spark, d: op10(table(spark, d, "documents")),
        "op11_whitening": lambda spark, d: op11(table(spark, d, "embeddings")),
        "op12_codes": lambda spark, d: op12(table(spark, d, "embeddings")),
        "op13_langid": lambda spark, d: op13(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": SQL1, "op3_mixing": SQL3, "op12_codes": SQL12}
