r"""Personal data: patterns for direct identifiers, and information-theoretic sanitisation around them.

Base spans are found by patterns (see ``PATTERNS``; each kind by itself, leftmost and not
overlapping; what fails its check is dropped without another try). Each value found is a protected
entity. Words that stand within ``WINDOW`` characters of an entity are its terms: all that have a
letter, and numbers of ``DIGITS`` digits and more. Over all distinct texts of the corpus

    PMI(t; e) = log(N n(t, e) / (n(t) n(e))),   IC(e) = log(N / n(e))

n(t, e) counts texts with t near e, n(t) and n(e) texts with them. PMI / IC says which share of the
entity's information its term reveals; terms at or over ``THRESHOLD`` disclose it, however few texts
have the entity: beside one of a single text these are the words of at most N^(1 - ``THRESHOLD``)
texts. In texts with the entity, all their occurrences are spans of kind ``term``, except where they
touch a base span. ``sanitise`` generalises base spans to their kind and removes terms.

All of it runs as DataFrame functions. The counts cover every row; only terms whose texts beside
entities are by themselves too many to disclose are not counted further. Patterns are written
without backtracking, so long texts take linear time, and offsets (code points) are summed in blocks.

Null texts count as empty. Copies of a text count once in the statistics and get the same spans.
Null ids and repeated rows are kept as they are. Empty tables give empty results. Columns to keep must
not be called as those that are added or used; in a struct they can have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Work, free_names, maybe_in

KINDS = ("email", "ip", "card", "phone", "term")
#: What each kind needs in a text, and its pattern; the lookbehind and possessive forms match the same as the plain ones.
PATTERNS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": ("", r"[0-9](?:[\x20-]?+[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
WINDOW, THRESHOLD = 48, 0.9
#: Numbers of fewer digits are no terms; words with a letter always are.
DIGITS = 4
#: Matches whose offsets are summed at once.
RUN = 256

_SPAN = "struct<start: int, kind: int, end: int, value: string>"
_WORD = r"[\p{L}\p{N}]"


def located(text: Column, found: Column, between: Column, kind: int) -> Column:
    """array<span> of the matches ``found`` with the texts ``between`` them (one more)."""
    sizes = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("value")))
    runs = F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(1), F.size(found), F.lit(RUN)), lambda i: F.slice(sizes, i, F.lit(RUN)))).otherwise(F.array().cast("array<array<struct<gap: int, len: int, value: string>>>"))
    total = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x["gap"] + x["len"]))
    starts = F.aggregate(total, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(a, x):
        start = a["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["len"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + x["len"]).alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))

    begun = F.zip_with(runs, F.slice(starts, F.lit(1), F.size(runs)), lambda r, s: F.struct(r.alias("run"), s.alias("at")))
    return F.flatten(F.transform(begun, lambda b: F.aggregate(b["run"], F.struct(b["at"].alias("at"), none["spans"].alias("spans")), step)["spans"]))


def luhn(text: Column) -> Column:
    digits = F.reverse(F.regexp_replace(text, "[^0-9]", ""))
    value = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 1, value(i)).otherwise(F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i)))
    fits = F.length(digits).between(12, 19)
    return fits & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda a, i: a + doubled(i)) % 10 == 0)


def _checked(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda s: _checked(kind, s["value"])


def base_spans(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with ``base``: array<span> by start, then kind."""
    text, empty = F.col(text_col), F.array().cast("array<string>")
    digits = text.rlike("[0-9]")
    out = rows
    for kind, (needs, pattern) in PATTERNS.items():
        may = F.contains(text, F.lit(needs)) if kind == "email" else digits & F.contains(text, F.lit(needs))
        out = out.withColumn(f"_m_{kind}", F.when(may, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(empty))
    for k, (kind, (_, pattern)) in enumerate(PATTERNS.items()):
        out = out.withColumn(f"_p_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split(text, pattern, -1)).otherwise(empty))
    for k, kind in enumerate(PATTERNS):
        found = located(text, F.col(f"_m_{kind}"), F.col(f"_p_{kind}"), k)
        out = out.withColumn(f"_s_{kind}", F.filter(found, _check(kind)))
    out = out.withColumn("base", F.array_sort(F.concat(*[F.col(f"_s_{kind}") for kind in PATTERNS])))
    return out.drop(*[f"_{x}_{kind}" for x in "mps" for kind in PATTERNS])


def entity(span: Column) -> Column:
    """The protected entity of a span: its kind with the address in lower case or the digits."""
    return F.concat(span["kind"].cast("string"), F.lit(":"), F.when(span["kind"] == 0, F.lower(span["value"])).otherwise(F.regexp_replace(span["value"], "[^0-9]", "")))


def near_words(text: Column, span: Column) -> Column:
    """The whole words, in lower case, within ``WINDOW`` characters of a span."""
    cut = r"[^\p{L}\p{N}]+"
    before = F.split(F.substr(text, F.greatest(span["start"] - WINDOW, F.lit(0)) + 1, F.least(span["start"], F.lit(WINDOW))), cut, -1)
    after = F.split(F.substr(text, span["end"] + 1, F.lit(WINDOW)), cut, -1)
    # The word at a cut end may be a part of one.
    whole_before = F.when(span["start"] > WINDOW, F.slice(before, F.lit(2), F.greatest(F.size(before) - 1, F.lit(0)))).otherwise(before)
    whole_after = F.when(span["end"] + WINDOW < F.length(text), F.slice(after, F.lit(1), F.greatest(F.size(after) - 1, F.lit(0)))).otherwise(after)
    return F.filter(F.transform(F.concat(whole_before, whole_after), F.lower), lambda w: (F.length(w) >= DIGITS) | w.rlike(r"\p{L}"))


def disclosing(base: DataFrame, texts: DataFrame, work: Work) -> DataFrame:
    """(entity, term): the terms whose corpus statistics reveal an entity.

    ``base``: (th, near array<struct<entity, terms>>) of the texts that hold entities, a row a row;
    ``texts``: (th, text) of all rows.
    """
    said = base.select("th", F.explode("near").alias("x")).select("th", "x.entity", "x.terms")
    pairs = work.table(said.select("th", "entity", F.explode(F.array_distinct("terms")).alias("term")).distinct(), "pairs")
    total = work.table(texts.select("th").distinct().agg(F.count("*").alias("n")), "total").first()["n"]
    n = F.lit(float(max(total, 1)))
    entities = said.select("th", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    both = work.table(pairs.groupBy("entity", "term").agg(F.count("*").alias("both")).join(entities, "entity"), "both")
    # By the threshold n(t) is at most this, and it is at least the texts with t near any entity.
    most = both.groupBy("term").agg(F.max(F.col("both") * F.pow(n / F.col("n_e"), F.lit(1 - THRESHOLD))).alias("most"))
    beside = pairs.select("th", "term").distinct().groupBy("term").agg(F.count("*").alias("beside"))
    terms = work.table(most.join(beside, "term").where(F.col("beside") <= 1.000001 * F.col("most")).select("term"), "terms")
    # Every row counts for its words; a text of c copies then takes c - 1 back, so it counts once.
    several = work.table(texts.groupBy("th").count().where("count > 1").select("th"), "several")
    copies = maybe_in(texts, F.col("th"), several, F.col("th")).groupBy("th").agg(F.first("text").alias("text"), F.count("*").alias("c")).where("c > 1")
    weighed = texts.select("text", F.lit(1).cast("long").alias("w")).unionByName(copies.select("text", (1 - F.col("c")).alias("w")))
    words = weighed.select("w", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+", -1))).alias("term")).where(F.length("term") > 0)
    # Summed in each task before anything is joined, so what is exchanged grows with the vocabulary.
    count = words.groupBy("term").agg(F.sum("w").alias("n_t")).join(terms, "term")
    pmi, ic = F.log(n * F.col("both") / (F.col("n_t") * F.col("n_e"))), F.log(n / F.col("n_e"))
    # n(t) counts at least the texts with t beside e (a word may be cut otherwise elsewhere).
    rare = maybe_in(both, F.col("term"), terms, F.col("term")).join(terms, "term")
    known = rare.join(count, "term", "left").withColumn("n_t", F.greatest(F.coalesce("n_t", F.lit(0).cast("long")), F.col("both")))
    return work.table(known.where((ic > 0) & (pmi >= THRESHOLD * ic)).select("entity", "term"), "disclosing")


def find(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` with base and terms (array<span> each), a row per row of ``docs``."""
    work = Work(docs.sparkSession, "personal")
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(*keep, text.alias("__text"), F.unhex(F.md5(text)).alias("th"))
    free_names(docs.select(*keep), "th", "base", "near", "terms")
    names = [c for c in source.columns if c not in ("__text", "th")]
    near = F.transform("base", lambda s: F.struct(entity(s).alias("entity"), near_words(F.col("__text"), s).alias("terms")))
    base = work.table(base_spans(source, "__text").select(*names, "th", "base", near.alias("near")), "base")
    some = base.where(F.size("base") > 0)
    told = disclosing(some.select("th", "near"), docs.select(F.unhex(F.md5(text)).alias("th"), text.alias("text")), work)
    # Written, so that Spark can split the join of an entity that very many texts share.
    of = work.table(some.select("th", F.explode(F.transform("near", lambda x: x["entity"])).alias("entity")).distinct(), "of")
    terms = work.table(of.join(told, "entity").groupBy("th").agg(F.array_sort(F.collect_set("term")).alias("words")), "terms")
    hit = maybe_in(docs.select(F.unhex(F.md5(text)).alias("th"), text.alias("text")), F.col("th"), terms, F.col("th")).join(terms, "th")
    hit = hit.dropDuplicates(["th"])
    pattern = F.concat(F.lit(rf"(?iu)(?<!{_WORD})(?:"), F.array_join("words", "|"), F.lit(rf")(?!{_WORD})"))
    hit = hit.withColumn("pattern", pattern).withColumn("m", F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).withColumn("p", F.expr("split(text, pattern, -1)"))
    spans = work.table(hit.select("th", located(F.col("text"), F.col("m"), F.col("p"), 4).alias("terms")), "spans")
    touched = lambda t: F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    out = base.join(spans, "th", "left")
    return out.select(*names, "base", F.coalesce(F.filter("terms", lambda t: ~touched(t)), F.array().cast(f"array<{_SPAN}>")).alias("terms"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, by start, then kind, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(text: Column, base: Column, terms: Column) -> Column:
    """The text with base spans generalised to ``<KIND>`` and terms removed; of overlapping spans the first holds."""
    text = F.coalesce(text, F.lit(""))
    name = lambda k: F.element_at(F.array(*[F.lit(f"<{n.upper()}>") for n in KINDS[:4]], F.lit("")), k + 1)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        cut = F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), name(s["kind"]))
        return F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), cut.alias("out")))

    return F.aggregate(F.array_sort(F.concat(base, terms)), start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))


def digests(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "terms")).alias("spans"), F.size(F.concat("base", "terms")).cast("long").alias("n_spans"),
    )
