"""Conversations as training text: rendered by a compiled template, with a loss mask, and read back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.chat_template import compile_template
from tablelens.llm.common import batched, parts

# The strings that mean something in formatted text. All begin with < or [ and have neither further on.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|says|>", "<|end|>")
TEMPLATE = (
    "<s>{% for m in messages %}<|turn|>{{ m.role | escape }}<|says|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|end|>{% endfor %}</s>"
)
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>", re.S)


def escape(text: str | None) -> str:
    """Doubles backslashes and puts one behind the first character of every control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], (text or "").replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Undoes ``escape``: of two backslashes one stays, a single one goes."""
    return re.sub(r"\\(\\?)", r"\1", text)


@lru_cache(maxsize=16)
def renderer(template: str):
    return compile_template(template, {"escape": escape})


def format_conversations(turns: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col, formatted, mask`` (spans of generated text in characters, end exclusive).

    Rows go to their conversation's task in the order of turns and are read as a stream, so a task holds one
    conversation at a time, however many there are. Null turns come last, equal turns in the order of role and
    text; repeated rows are turns of their own. Null roles and texts count as empty. Rows without a conversation
    make one conversation whose id is null. An empty table gives an empty result.
    """
    batched(turns.sparkSession)
    kind = turns.schema[conv_col].dataType.simpleString()
    renderer(template)  # a wrong template fails here
    rows = turns.select(F.col(conv_col).alias("_c"), F.col(turn_col).alias("_t"), F.coalesce(role_col, F.lit("")).alias("_role"), F.coalesce(text_col, F.lit("")).alias("_text"))
    rows = rows.repartition(parts(turns.sparkSession), "_c").sortWithinPartitions(F.asc_nulls_last("_c"), F.asc_nulls_last("_t"), "_role", "_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = renderer(template)
        open_id, messages, out = None, [], []

        def close() -> None:
            text, spans = render(messages=messages)
            out.append((open_id, text, spans))

        for batch in batches:
            ids = batch["_c"].astype(object).where(batch["_c"].notna(), None).tolist()
            for c, role, text in zip(ids, batch["_role"], batch["_text"]):
                if messages and c != open_id:
                    close()
                    messages = []
                open_id = c
                messages.append({"role": role, "text": text})
            if out:
                yield pd.DataFrame({"_c": pd.Series([o[0] for o in out], dtype=object), "formatted": [o[1] for o in out], "mask": [o[2] for o in out]})
                out = []
        if messages:
            close()
            yield pd.DataFrame({"_c": pd.Series([open_id], dtype=object), "formatted": [out[-1][1]], "mask": [out[-1][2]]})

    made = rows.mapInPandas(run, f"_c {kind}, formatted string, mask array<array<long>>")
    return made.select(F.col("_c").alias(conv_col), "formatted", F.transform("mask", lambda s: F.struct(s[0].alias("start"), s[1].alias("end"))).alias("mask"))


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per formatted conversation: ``conv_col, turns`` (role, text), ``loss_text``, all unescaped, and ``formatted_chars``."""
    batched(formatted.sparkSession)
    kind = formatted.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            turns = [[{"role": unescape(r), "text": unescape(t)} for r, t in _TURN.findall(x)] for x in batch["formatted"]]
            loss = ["".join(unescape(x[a:b]) for a, b in zip(s, e)) for x, s, e in zip(batch["formatted"], batch["_starts"], batch["_ends"])]
            yield pd.DataFrame({"_c": batch["_c"], "turns": turns, "loss_text": loss, "formatted_chars": batch["formatted"].map(len)})

    rows = formatted.select(F.col(conv_col).alias("_c"), "formatted", F.col("mask.start").alias("_starts"), F.col("mask.end").alias("_ends"))
    return rows.mapInPandas(run, f"_c {kind}, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long").withColumnRenamed("_c", conv_col)
