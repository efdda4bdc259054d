"""The subpackage's queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, mixing
from .chat import op2_chat_format
from .decontaminate import op9_decontaminate
from .gif import op6_gif
from .jaccard_join import op10_ngram_jaccard
from .licenses import op8_licenses
from .mixing import op5_mixing
from .pii import op3_pii
from .quality import op4_quality
from .secrets import op7_secrets
from .token_ids import op1_token_ids


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_ids, op2_chat_format, op3_pii, op4_quality, op5_mixing, op6_gif, op7_secrets, op8_licenses, op9_decontaminate, op10_ngram_jaccard)
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    """Of the others SQL cannot express the method (or not on whole tables); tests hold them against brute force."""
    return {"op2_chat_format": chat.ORACLE_SQL, "op5_mixing": mixing.ORACLE_SQL, "op9_decontaminate": decontaminate.ORACLE_SQL}
