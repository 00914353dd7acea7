"""Answers of language models: a typed hook to ask one, reading of its JSON, repair of message lists.

No model is called unless the caller gives one; all else is expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: the words that an action may be said with ---
FINISH_WORDS = ("end", "stop", "done", "complete", "exit", "quit", "terminate", "finish")
SCRAPE_WORDS = ("scrape", "continue", "go", "run", "start", "crawl", "begin")
SCRAPE_SIGNALS = ("scrape", "继续", "深入")
PLACEHOLDER = "工具执行失败，无返回结果"


def ask(rows: DataFrame, prompt: str, client: Callable[[], Callable[[str], tuple[str, int, int]]], keep: list[str], tries: int = 2) -> DataFrame:
    """``keep`` with answer, prompt_tokens, answer_tokens and error, a row per row.

    ``client`` is called once a task and gives a function from a prompt to (answer, tokens in, tokens
    out). After ``tries`` exceptions the answer is null and the error says why.
    """
    kept = rows.select(*keep, F.col(prompt).alias("__prompt"))
    extra = [T.StructField("answer", T.StringType()), T.StructField("prompt_tokens", T.LongType()), T.StructField("answer_tokens", T.LongType()), T.StructField("error", T.StringType())]

    def one(call, text):
        for _ in range(tries):
            try:
                return (*call(text), None)
            except Exception as e:  # a row for every prompt
                error = f"{type(e).__name__}: {e}"
        return (None, 0, 0, error)

    def each(batches):
        call = client()
        for b in batches:
            got = [one(call, text) for text in b["__prompt"]]
            yield b.drop(columns="__prompt").assign(**{f.name: [g[i] for g in got] for i, f in enumerate(extra)})

    return kept.mapInPandas(each, T.StructType([*kept.drop("__prompt").schema.fields, *extra]))


def json_in(text: Column) -> Column:
    """The JSON object that an answer holds as a variant: all of it, a fenced block, what stands in braces; else null."""
    text = F.coalesce(text, F.lit(""))
    found = [F.btrim(text), F.btrim(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)), F.regexp_extract(text, r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", 0)]
    read = [F.when(F.startswith(t, F.lit("{")), F.try_parse_json(t)) for t in found]
    return F.coalesce(*[F.when(F.try_variant_get(v, "$.action", "string").isNotNull(), v) for v in read])


def decision(text: Column) -> Column:
    """struct(action, reasoning, priority_url) of an answer: from its JSON, else by the words in it; finish by default."""
    v, low = json_in(text), F.lower(F.coalesce(text, F.lit("")))
    said = F.lower(F.try_variant_get(v, "$.action", "string"))
    word = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit("scrape")) for w in SCRAPE_SIGNALS], F.lit("finish"))
    action = F.when(v.isNull(), word).when(said.isin(*SCRAPE_WORDS), "scrape").otherwise("finish")
    field = lambda name: F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))
    return F.struct(action.alias("action"), field("reasoning").alias("reasoning"), field("priority_url").alias("priority_url"))


def sanitised(messages: DataFrame, by: str = "conv_id") -> DataFrame:
    """Messages with a placeholder behind each call that has no result in its conversation.

    ``messages``: by, pos, role, content, calls array<string>, result_of string. Placeholders have the
    call's ``pos`` and a ``part`` from 1 on, others 0: the order is by pos, part. A call without an id needs none.
    """
    rows = messages.withColumn("part", F.lit(0))
    calls = messages.select(by, "pos", F.posexplode("calls").alias("i", "call")).where(F.coalesce("call", F.lit("")) != "")
    results = messages.where("result_of is not null").select(F.col(by).alias("_by"), F.col("result_of").alias("_of"), F.col("pos").alias("_pos"))
    open_ = calls.join(results, calls[by].eqNullSafe(results["_by"]) & (calls["call"] == results["_of"]) & (results["_pos"] > calls["pos"]), "left_anti")
    none = F.array().cast("array<string>")
    more = open_.select(by, "pos", F.lit("tool").alias("role"), F.lit(PLACEHOLDER).alias("content"), none.alias("calls"), F.col("call").alias("result_of"), (F.col("i") + 1).cast("int").alias("part"))
    return rows.select(by, "pos", "role", "content", "calls", "result_of", "part").unionByName(more)
