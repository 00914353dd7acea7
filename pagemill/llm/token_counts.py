"""Token counts with a shortcut for pre-tokens that are whole tokens.

A byte-level BPE tokenizer cuts a text into pre-tokens and merges bytes inside each. Most pre-tokens
of real text are strings of the vocabulary that encode as themselves. ``whole_tokens`` proves which:
it encodes every vocabulary string alone and keeps those that give one token. That set, bounded by
the vocabulary, is broadcast; a task counts one for each pre-token in it and merges only the distinct
others of a block.

Merging uses ranks of those tokens that encode alone as one (``reachable``). No other token can arise
in any word: while nothing has merged across a token's ends, its inside merges as it does alone. For
the same reason the last merge that makes a token is always the one of its own string, so merging any
two neighbours that together are a reachable token, lowest rank first, equals following the file's
list of pairs. ``tiktoken`` merges by such ranks; very long words go to the tokenizers library.

Pre-tokens are found for a whole block at once with array operations on its characters. A character's
class (letter, number, white space, other) is asked of the library itself the first time a task
meets it, so results follow the library's version of Unicode, not Python's or Java's.

Nothing is shuffled. A block is ``BLOCK`` characters of one or several texts; a longer text is taken in
pieces cut where white space follows a word, which is a border of pre-tokens whatever stands beside
it, so memory is bounded but for a single word of more than that size.

Null texts count as empty: no bytes, no tokens. Added tokens inside texts are one token each, as in
the library by default. Repeated rows are counted each; empty tables give empty results. Columns to
keep travel in a struct, so their names cannot clash with those used here, save the three added ones.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import bounded_batches, free_names, released

#: Characters of texts that are looked at together.
BLOCK = 2_000_000
#: Words that are merged in one go, as lines of a text.
LINES = 16_384
#: Bytes of a word above which it is merged alone.
LONG = 400
#: Tokens above which ``over_limit`` is true.
LIMIT = 1024

_OTHER, _LETTER, _NUMBER, _SPACE, _UNKNOWN = range(5)


def checked(spec: str) -> list[str]:
    """The added tokens of a tokenizer file whose counts this module can give; others are refused."""
    s = json.loads(spec)
    pre, model = s.get("pre_tokenizer") or {}, s["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or s.get("normalizer") or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError("a byte-level BPE tokenizer without normaliser, prefix space and dropout is needed")
    if any(t[k] for t in s["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens must match as they stand")
    return [t["content"] for t in s["added_tokens"]]


def reachable(tok, spec: str) -> dict[bytes, int]:
    """The ranks of all tokens that can arise: single bytes first, then those whose string merges to one token."""
    byte = {c: b for b, c in _byte_letters().items()}
    ranks = {bytes([b]): i for i, b in enumerate(byte.values())}
    for i, pair in enumerate(json.loads(spec)["model"]["merges"]):
        piece = "".join(pair.split(" ") if isinstance(pair, str) else pair)
        data = bytes(byte[c] for c in piece)
        if data in ranks:
            raise ValueError("two pairs of the tokenizer make one token")
        if len(tok.model.tokenize(piece)) == 1:
            ranks[data] = 256 + i
    return ranks


def whole_tokens(tok, ranks: dict[bytes, int], added: list[str]) -> list[str]:
    """The strings of tokens that are one token when encoded alone, as the library does it with texts."""
    texts = []
    for data in ranks:
        try:
            texts.append(data.decode())
        except UnicodeDecodeError:  # part of a character: never a pre-token
            continue
    texts = [t for t in texts if t not in added]
    got = tok.encode_batch_fast(texts, add_special_tokens=False)
    return sorted(t for t, e in zip(texts, got) if len(e.ids) == 1)


def _byte_letters() -> dict[int, str]:
    """The letter for each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter:
    """Counts tokens of texts; one per task."""

    def __init__(self, tok, added: list[str], ranks: dict[bytes, int], whole: list[str]):
        import pyarrow as pa
        import tiktoken

        self.tok, self.whole, self.line = tok, pa.array(whole, pa.string()), ranks[b"\n"]
        self.merger = tiktoken.Encoding("lines", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)
        self.cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def _kind(self, chars: np.ndarray) -> np.ndarray:
        kinds = self.kinds[chars]
        if (kinds == _UNKNOWN).any():
            new = np.unique(chars[kinds == _UNKNOWN])
            self.kinds[new] = _SPACE
            for probe, kind in (("a", _LETTER), ("1", _NUMBER), ("!", _OTHER)):
                for at in range(0, len(new), 4096):
                    part = new[at : at + 4096]
                    begins = np.zeros(3 * len(part) + 1, bool)
                    begins[[o[0] for _, o in self.tok.pre_tokenizer.pre_tokenize_str("".join(f"{probe}{chr(c)}\n" for c in part))]] = True
                    self.kinds[part[~begins[1::3][: len(part)]]] = kind
            kinds = self.kinds[chars]
        return kinds

    def _begins(self, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin; ``first`` marks the first character of each segment."""
        n = len(chars)
        kind = self._kind(chars)
        before = np.concatenate([[_UNKNOWN], kind[:-1]])
        run = first | (kind != before)
        space = kind == _SPACE
        last = np.concatenate([run[1:], [True]]) & space  # the last of a run of white space ...
        closing = np.concatenate([first[1:], [True]])
        last &= ~closing  # ... that something follows
        blank = np.concatenate([[False], chars[:-1] == 32]) & ~first  # a blank before it in the segment
        begins = (space & run) | last | (~space & run & ~blank)
        # Contractions: an apostrophe where a pre-token begins takes the letters of its ending along.
        at = np.flatnonzero(begins & (chars == 39) & ~closing)
        if len(at):
            pad = np.concatenate([chars, [0, 0]])
            inside = np.concatenate([first, [True, True]])
            one, two = pad[at + 1], np.where(inside[at + 2], 0, pad[at + 2])
            is_one = np.isin(one, [ord(c) for c in "stmd"])
            is_two = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for hits, length in ((at[is_one], 2), (at[is_two], 3)):
                begins[hits + 1] = False
                after = hits + length
                after = after[after < n]
                begins[after] |= kind[after] == _LETTER
        return begins

    def _merged(self, words) -> np.ndarray:
        """Tokens of each of an arrow array of words without line ends."""
        import pyarrow as pa
        import pyarrow.compute as pc

        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()
        ids = np.array(self.merger.encode_ordinary(text), np.int64)
        return np.diff(np.concatenate([[-1], np.flatnonzero(ids == self.line), [len(ids)]])) - 1

    def _sums(self, texts: list[str]) -> np.ndarray:
        """Tokens of texts without added tokens, none of them empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.zeros(len(chars), bool)
        first[np.cumsum(size) - size] = True
        begin = np.flatnonzero(self._begins(chars, first))
        data = joined.encode()
        if len(data) == len(chars):
            at = begin
        else:
            width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
            at = (np.cumsum(width) - width)[begin]
        cuts = np.concatenate([at, [len(data)]]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        names = coded.dictionary.cast(pa.string())
        counts = np.ones(len(names), np.int64)
        merged = pc.invert(pc.is_in(names, value_set=self.whole)).to_numpy(zero_copy_only=False)
        alone = merged & pc.or_(pc.match_substring(names, "\n"), pc.greater(pc.binary_length(names), LONG)).to_numpy(zero_copy_only=False)
        counts[alone] = [len(e.ids) for e in self.tok.encode_batch_fast(names.filter(pa.array(alone)).to_pylist(), add_special_tokens=False)]
        lines = np.flatnonzero(merged & ~alone)
        for s in range(0, len(lines), LINES):
            counts[lines[s : s + LINES]] = self._merged(names.take(pa.array(lines[s : s + LINES])))
        segment = np.cumsum(first)[begin] - 1
        return np.bincount(segment, counts[coded.indices.to_numpy(zero_copy_only=False)], len(texts)).astype(np.int64)

    def counts(self, texts: list[str | None], block: int = BLOCK) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        held, of, size = [], [], 0

        def done():
            nonlocal held, of, size
            if held:
                np.add.at(out, of, self._sums(held))
            held, of, size = [], [], 0

        for i, text in enumerate(texts):
            segments = [text or ""]
            if self.cut is not None and text:
                segments = self.cut.split(text)
                out[i] += len(segments) - 1
            for piece in (p for s in segments for p in _pieces(s, block)):
                held.append(piece)
                of.append(i)
                size += len(piece)
                if size >= block:
                    done()
        done()
        return out


#: Where a text can be cut without changing its pre-tokens: ASCII white space after a letter or digit.
_BORDER = re.compile(r"(?<=[A-Za-z0-9])[\x20\x09-\x0D]")


def _pieces(text: str, most: int):
    """A text in pieces of about ``most`` characters, cut between pre-tokens; nothing for an empty text."""
    begin = 0
    while len(text) - begin > most:
        border = _BORDER.search(text, begin + most)
        if border is None:
            break
        yield text[begin : border.start()]
        begin = border.start()
    if begin < len(text):
        yield text[begin:]


def count(docs: DataFrame, tokenizer_path: str, keep: list[Column], text_col: str = "text", limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """``keep`` with n_bytes and n_tokens (longs) and over_limit (boolean: more than ``limit`` tokens)."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    added = checked(spec)
    free_names(docs.select(*keep), "n_bytes", "n_tokens", "over_limit")
    kept = docs.select(*keep).schema.fields
    tok = Tokenizer.from_str(spec)
    ranks = reachable(tok, spec)
    sent = spark.sparkContext.broadcast((spec, added, ranks, whole_tokens(tok, ranks, added)))

    def each(batches):
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(Tokenizer.from_str(sent.value[0]), *sent.value[1:])
        for b in batches:
            n = counter.counts(b.column(1).to_pylist(), block)
            yield pa.RecordBatch.from_arrays([*b.column(0).flatten(), b.column(2), pa.array(n), pa.array(n > limit)], names)

    names = [*[f.name for f in kept], "n_bytes", "n_tokens", "over_limit"]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in kept], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    text = F.col(text_col)
    rows = docs.select(F.struct(*keep).alias("kept"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(released(each), schema)
