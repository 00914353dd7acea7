"""Repair of conversations whose roles, order or texts were damaged.

The rows of a conversation are edited at least cost until the initials of their roles follow
``(s?(ua)+)?``. Where a conversation stands is one of four states (begun, after a system turn, after a
user turn, after an assistant turn). From the last row back, the cost to go from every state is found;
from the first row on, the walk takes, of the edits that keep to that cost, the one with the least
letter (Delete, Insert, Keep, Rerole). As a letter decides the next state, that walk's letters are the
least in ASCII order of all cheapest ones. Costs to go differ between states by ten at most, so their
patterns are few: a row is one step of a memo table, and a conversation needs two bytes a row.

Rows are ordered by (conversation, turn, role, text) through ranges, so that a conversation of any size
is dealt over many tasks. A task finishes the conversations that lie inside it and puts out the others in
segments. For these only the codes of the rows (a byte each) meet, for the walk; edits are applied
to segments where they are, and the repaired segments run through one hash in order, a segment at a
time. Nothing but that hash and the row's own edits, which are cells of the result, is sequential.

Odd input: nulls of any column but a null turn's place count as one space; a null conversation is one
conversation. Rows of one turn follow each other by role, then text. Equal rows are counted before
they move. Roles of another initial can only be deleted or given a new role. Empty tables give empty
results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import SPACE, Work, bounded_batches, released

#: Costs of edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows and characters of a segment.
ROWS, CHARS = 20_000, 4_000_000

_ROLE = ("s", "u", "a")
_NONE, _BLANK, _AGAIN, _CUT = range(4)  # faults of a row
_INSERTED = (2, 2, 3, 2)  # the state after an inserted turn
_NAMES = {2: "user", 3: "assistant"}
_KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}  # (state, initial) -> state
_END = (0, 10, 5, 0)


def _edits(state: int, code: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row; a code is 4 * initial + fault."""
    initial, fault = divmod(code, 4)
    out = [("D", DELETE, state)]
    if fault in (_NONE, _CUT):
        more = TRUNCATED if fault == _CUT else 0
        if (state, initial) in _KEPT:
            out.append(("K", more, _KEPT[state, initial]))
        out.append(("R", REROLE + more, _INSERTED[state]))
    return out


class Walker:
    """The dynamic programme, with all patterns of costs to go that it has met."""

    def __init__(self):
        self.patterns, self.number = [_END], {_END: 0}
        self.before: dict[tuple[int, int], tuple[int, int]] = {}  # (pattern after the row, code) -> (pattern, cost)
        self.steps: dict[tuple[int, int, int], tuple[str, int]] = {}  # (state, pattern after the row, code) -> (letters, state)

    @staticmethod
    def _costs(after: tuple, code: int) -> list[int]:
        own = [min(c + after[q] for _, c, q in _edits(state, code)) for state in range(4)]
        one = [min(own[q], INSERT + own[_INSERTED[q]]) for q in range(4)]
        return [min(own[q], INSERT + one[_INSERTED[q]]) for q in range(4)]

    def _back(self, pattern: int, code: int) -> tuple[int, int]:
        if (pattern, code) not in self.before:
            costs = self._costs(self.patterns[pattern], code)
            found = tuple(c - min(costs) for c in costs)
            if found not in self.number:
                self.number[found] = len(self.patterns)
                self.patterns.append(found)
            self.before[pattern, code] = self.number[found], min(costs)
        return self.before[pattern, code]

    def _step(self, state: int, pattern: int, code: int) -> tuple[str, int]:
        if (state, pattern, code) not in self.steps:
            after, letters, q = self.patterns[pattern], "", state
            costs = self._costs(after, code)
            while True:
                tight = [(letter, to) for letter, c, to in _edits(q, code) if costs[q] == c + after[to]]
                if costs[q] == INSERT + costs[_INSERTED[q]]:
                    tight.append(("I", _INSERTED[q]))
                letter, q = min(tight)
                letters += letter
                if letter != "I":
                    break
            self.steps[state, pattern, code] = letters, q
        return self.steps[state, pattern, code]

    def walk(self, segments: list[bytes]) -> tuple[int, list[tuple[int, str]]]:
        """The cost of a conversation, and for each segment of its codes the state before it and its letters."""
        codes = b"".join(segments)
        after, pattern, cost = array("H", bytes(2 * len(codes))), 0, 0
        for i in range(len(codes) - 1, -1, -1):
            after[i] = pattern
            pattern, more = self._back(pattern, codes[i])
            cost += more
        cost += self.patterns[pattern][0]
        out, state, i = [], 0, 0
        for k, segment in enumerate(segments):
            began, letters = state, []
            for i in range(i, i + len(segment)):
                found, state = self._step(state, after[i], codes[i])
                letters.append(found)
            i += bool(segment)
            if k == len(segments) - 1:
                while _END[state]:
                    letters.append("I")
                    state = _INSERTED[state]
            out.append((began, "".join(letters)))
        return cost, out


def faults(codes: bytes) -> tuple[int, int, int, int]:
    """(blank, duplicate, truncated, illegal) of the rows of a conversation."""
    kinds = [sum(codes.count(4 * r + f) for r in range(4)) for f in (_BLANK, _AGAIN, _CUT)]
    initials = codes.translate(bytes(b // 4 for b in range(256)))
    return *kinds, sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:]))


def repaired(state: int, letters: str, rows) -> list[str]:
    """The lines ``role:text`` that edits make of rows (role, text)."""
    rows, out = iter(rows), []
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = _KEPT[state, _ROLE.index(role[0])]
        else:
            state = _INSERTED[state]
            role = _NAMES[state]
        out.append(f"{role}:{text}")
    return out


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every row as (conv, turn, role, text, copies) with the damage of its hash; a dropped one has no copies."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    said = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank(text), "[.!?]", "")).otherwise(blank(text))
    return df.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(blank(role)).alias("role"), said.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _coded(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies and codes: ``code`` of the first copy, ``again`` of others."""
    counted = rows.where("copies > 0").groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    counted = counted.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    often = counted.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("first"), F.sum("copies").alias("all")).where(F.col("all") > 1)
    joined = counted.join(often, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    initial = F.coalesce(*[F.when(F.col("role").startswith(x), i) for i, x in enumerate(_ROLE)], F.lit(3)) * 4
    blank = ~F.col("text").rlike(SPACE.replace("[", "[^"))
    fault = F.when(blank, _BLANK).when(F.col("first").isNotNull() & (F.col("first") != place), _AGAIN).when(~F.col("text").rlike(rf"[.!?]{SPACE}*\z"), _CUT).otherwise(_NONE)
    return joined.select("conv", "turn", "role", "text", "copies", (initial + fault).alias("code"), (initial + F.when(blank, _BLANK).otherwise(_AGAIN)).alias("again"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows dealt in ranges by (conv, turn, role, text) and sorted so; ranges look at the beginnings of strings only."""
    long = F.length("role") > 64
    near = [F.col("conv"), F.col("turn"), F.substring("role", 1, 64), long, F.when(long, "").otherwise(F.substring("text", 1, 64))]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *near).sortWithinPartitions("conv", "turn", "role", "text")


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]


def _segments(batches, types):
    """Finished conversations, and segments of those at the ends of a partition or too long for one segment."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, walker, out = TaskContext.get().partitionId() << 32, Walker(), []
    held, codes, size, conv, k, open_ = [], bytearray(), 0, None, 0, True

    def segment():
        nonlocal held, codes, size, k
        out.append((conv, part + k, bytes(codes), [r for r, _, _ in held], [t for _, t, _ in held], [n for _, _, n in held], *[None] * 7))
        held, codes, size, k = [], bytearray(), 0, k + 1

    def finished():
        nonlocal held, codes, size
        cost, [(state, letters)] = walker.walk([bytes(codes)])
        lines = repaired(state, letters, ((r, t) for r, t, n in held for _ in range(n)))
        out.append((conv, None, None, None, None, None, *faults(bytes(codes)), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
        held, codes, size = [], bytearray(), 0

    def batch():
        nonlocal out
        columns, out = list(zip(*out)), []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], types_names)

    types_names = ["conv", "part", "codes", "roles", "texts", "copies", *_COUNTS, "audit", "sha"]
    begun = False
    for b in batches:
        for c, role, text, n, code, again in zip(*[x.to_pylist() for x in b.columns]):
            if begun and c != conv:
                segment() if open_ else finished()
                open_ = False
            conv, begun = c, True
            held.append((role, text, n))
            codes += bytes([code]) + bytes([again]) * (n - 1)
            size += len(text)
            if len(codes) >= ROWS or size >= CHARS:
                segment()
                open_ = True
        if len(out) >= 1000 or sum(len(o[2] or b"") for o in out) > ROWS:
            yield batch()
    if held:
        segment()
    if out:
        yield batch()


def _walked(group):
    """The walk through a conversation's segments."""
    import pyarrow as pa

    rows = group.sort_by("part")
    codes = rows["codes"].to_pylist()
    cost, walks = Walker().walk(codes)
    counts = [*faults(b"".join(codes)), cost]
    n = len(codes)
    total = [pa.array([v, *[None] * (n - 1)], pa.int64()) for v in counts]
    audit = pa.array(["".join(w[1] for w in walks), *[None] * (n - 1)], pa.string())
    return pa.table([rows["part"], pa.array([w[0] for w in walks], pa.int64()), pa.array([w[1] for w in walks], pa.string()), *total, audit], names=["part", "state", "letters", *_COUNTS, "audit"])


def _rebuilt(batches):
    """Segments with their letters as repaired text; null where nothing is left of one."""
    import pyarrow as pa

    for b in batches:
        pieces = []
        for state, letters, roles, texts, copies in zip(*[b.column(c).to_pylist() for c in ("state", "letters", "roles", "texts", "copies")]):
            lines = repaired(state, letters, ((r, t) for r, t, n in zip(roles, texts, copies) for _ in range(n)))
            pieces.append("\n".join(lines) if lines else None)
        kept = ["conv", "part", *_COUNTS, "audit"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(pieces, pa.string())], [*kept, "piece"])


def _hashed(batches):
    """A row a conversation from its pieces in order, the first of which has its figures."""
    import pyarrow as pa

    names = ["conv", *_COUNTS, "audit", "sha"]
    figures, digest, empty = None, None, True
    for b in batches:
        out = []
        for i, (audit, piece) in enumerate(zip(b.column("audit").to_pylist(), b.column("piece").to_pylist())):
            if audit is not None:
                if figures is not None:
                    out.append((figures, digest.hexdigest()))
                figures, digest, empty = b.select(names[:-1]).slice(i, 1), hashlib.sha256(), True
            if piece is not None:
                digest.update(("" if empty else "\n").encode() + piece.encode())
                empty = False
        if out:
            yield _closed(out, names)
    if figures is not None:
        yield _closed([(figures, digest.hexdigest())], names)


def _closed(done, names):
    import pyarrow as pa

    table = pa.Table.from_batches([f for f, _ in done]).combine_chunks().to_batches()[0]
    return pa.RecordBatch.from_arrays([*table.columns, pa.array([d for _, d in done])], names)


def repair(rows: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit, sha) for rows (conv, turn, role, text, copies) of conversations with any row left."""
    spark = rows.sparkSession
    bounded_batches(spark)
    work = Work(spark, "repair")
    conv = rows.schema["conv"].dataType
    counts = [T.StructField(c, T.LongType()) for c in _COUNTS]
    strings, longs = T.ArrayType(T.StringType()), T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("conv", conv), T.StructField("part", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("roles", strings), T.StructField("texts", strings), T.StructField("copies", longs), *counts, T.StructField("audit", T.StringType()), T.StructField("sha", T.StringType())])

    def segments(batches):
        import pyarrow as pa
        from itertools import chain

        first = next(batches, None)
        if first is not None:
            many = pa.list_(pa.string())
            yield from _segments(chain([first], batches), [first.column(0).type, pa.int64(), pa.binary(), many, many, pa.list_(pa.int64()), *[pa.int64()] * 5, pa.string(), pa.string()])

    ordered = _ordered(_coded(rows)).select("conv", "role", "text", "copies", "code", "again")
    table = work.table(ordered.mapInArrow(released(segments), schema), "segments")
    parts = table.where("part is not null")
    walked = parts.select("conv", "part", "codes").groupBy("conv").applyInArrow(_walked, T.StructType([T.StructField("part", T.LongType()), T.StructField("state", T.LongType()), T.StructField("letters", T.StringType()), *counts, T.StructField("audit", T.StringType())]))
    left = parts.select("conv", "part", "roles", "texts", "copies").join(walked, "part")
    pieces = left.mapInArrow(_rebuilt, T.StructType([T.StructField("conv", conv), T.StructField("part", T.LongType()), *counts, T.StructField("audit", T.StringType()), T.StructField("piece", T.StringType())]))
    names = ["conv", *_COUNTS, "audit", "sha"]
    hashed = pieces.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_hashed, T.StructType([T.StructField("conv", conv), *counts, T.StructField("audit", T.StringType()), T.StructField("sha", T.StringType())]))
    return table.where("part is null").select(*names).unionByName(hashed)


def audit(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every conversation of a table with its gaps, faults, cheapest edits and the hash of its repaired turns, after ``damage``."""
    rows = damage(df, conv, turn, role, text)
    left = F.when(F.col("copies") > 0, F.col("turn"))
    span = F.max(left).cast("decimal(20, 0)") - F.min(left).cast("decimal(20, 0)") + 1 - F.count_distinct(left)
    every = rows.groupBy(F.col("conv").alias(conv)).agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    found = every.join(repair(rows), F.col(conv).eqNullSafe(F.col("conv")), "left")
    zero: list[Column] = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in _COUNTS]
    return found.select(conv, "gaps", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: The same in DuckDB's SQL: the hash, the damage, costs to go by recursion from the last row, the walk by recursion from the first.
ORACLE = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab
), given AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM conversations, crc
), damaged AS (
  SELECT k, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM given)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), told AS (
  SELECT *, left(role, 1) AS ini, CASE
    WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
    fault IN ('truncated', '') AS free, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS t,
    left(lag(role) OVER (PARTITION BY k ORDER BY i), 1) || left(role, 1) AS pair
  FROM placed
), sums AS (
  SELECT k, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY k
), togo(k, i, f) AS (
  SELECT k, n + 1, [0, 10, 5, 0] FROM sums
  UNION ALL
  SELECT k, i, [least(o[1], 5 + o[3], 10 + o[4]), least(o[2], 5 + o[3], 10 + o[4]), least(o[3], 5 + o[4]), least(o[4], 5 + o[3])] FROM (
    SELECT r.k, r.i, [
      least(2 + f[1], CASE WHEN free AND ini = 's' THEN t + f[2] WHEN free AND ini = 'u' THEN t + f[3] END, CASE WHEN free THEN 1 + t + f[3] END),
      least(2 + f[2], CASE WHEN free AND ini = 'u' THEN t + f[3] END, CASE WHEN free THEN 1 + t + f[3] END),
      least(2 + f[3], CASE WHEN free AND ini = 'a' THEN t + f[4] END, CASE WHEN free THEN 1 + t + f[4] END),
      least(2 + f[4], CASE WHEN free AND ini = 'u' THEN t + f[3] END, CASE WHEN free THEN 1 + t + f[3] END)] AS o
    FROM togo JOIN told r ON r.k = togo.k AND r.i = togo.i - 1)
), walk(k, i, q, audit, lines) AS (
  SELECT k, 1::BIGINT, 1, '', []::VARCHAR[] FROM sums
  UNION ALL
  SELECT k, CASE letter WHEN 'I' THEN i ELSE i + 1 END, CASE letter WHEN 'D' THEN q WHEN 'K' THEN kept ELSE put END, audit || letter,
    CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, CASE put WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE letter WHEN 'R' THEN text ELSE '' END) END
  FROM (
    SELECT s.*, CASE WHEN after IS NOT NULL AND here[q] = 2 + after[q] THEN 'D' WHEN here[q] = 5 + here[put] THEN 'I' WHEN free AND here[q] = t + after[kept] THEN 'K' ELSE 'R' END AS letter FROM (
      SELECT w.*, a.f AS here, b.f AS after, r.role, r.text, r.free, r.t, [3, 3, 4, 3][q] AS put,
        CASE WHEN q = 1 AND ini = 's' THEN 2 WHEN q <> 3 AND ini = 'u' THEN 3 WHEN q = 3 AND ini = 'a' THEN 4 END AS kept
      FROM walk w JOIN togo a ON a.k = w.k AND a.i = w.i LEFT JOIN togo b ON b.k = w.k AND b.i = w.i + 1 LEFT JOIN told r ON r.k = w.k AND r.i = w.i
      WHERE NOT (b.f IS NULL AND q IN (1, 4))) s)
), ends AS (
  SELECT w.k, audit, lines FROM walk w JOIN sums ON sums.k = w.k WHERE w.i = n + 1 AND q IN (1, 4)
)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(f[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM given) g LEFT JOIN sums USING (k) LEFT JOIN ends USING (k) LEFT JOIN togo ON togo.k = g.k AND togo.i = 1
"""
