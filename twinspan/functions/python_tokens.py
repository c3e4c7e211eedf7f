"""Python lexing with the standard library, one Arrow batch at a time."""

from __future__ import annotations

import io
import textwrap
import tokenize

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYOUT = {
    tokenize.INDENT: "INDENT",
    tokenize.DEDENT: "DEDENT",
    tokenize.NEWLINE: "NEWLINE",
}
SKIPPED = (tokenize.COMMENT, tokenize.NL, tokenize.ENDMARKER)


def lex(code: str) -> list[str] | None:
    """Tokens with layout markers, or None when the text is not lexable Python."""
    out = []
    try:
        for tok in tokenize.generate_tokens(io.StringIO(textwrap.dedent(code)).readline):
            if tok.type in LAYOUT:
                out.append(LAYOUT[tok.type])
            elif tok.type not in SKIPPED and tok.string.strip():
                out.append(tok.string)
    except (tokenize.TokenError, IndentationError):
        return None
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def python_tokens(code: pd.Series) -> pd.Series:
    return code.map(lex, na_action="ignore")
