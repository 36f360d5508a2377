"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Every prefix of a byte string has exactly one last token with which its encoding can end. The table of those last
tokens is built from left to right: a vocabulary token that ends at a prefix is its last token if it may follow the
last token of the shorter prefix, that is if merging would have kept the two apart. The encoding is read off
backwards. Because a prefix's entry never depends on later bytes, bytes can be appended exactly, and after an edit
only entries near it are made anew (see `PrefixTable`).

Texts are split by the tokenizer's pattern, each match encoded separately; the matches' ids are kept in a bounded
cache of each Python worker. Null is the empty text, without tokens. Repeated rows, empty tables and texts of any
length give what each row alone gives; further columns are passed over.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import ship, table, trim

#: Matches whose ids a worker keeps at most (the half not met of late goes), and pairs of tokens whose standing it keeps.
CACHE, PAIRS = 500_000, 400_000
#: Unicode's White_Space, as it stands between brackets.
WHITE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def white(pattern: str) -> str:
    r"""The pattern with `\s` and `\S` written as Unicode's White_Space, alike in every regex library."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WHITE if inside else f"[{WHITE}]")
        elif two == r"\S":
            out.append(f"[^{WHITE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Bpe:
    """A vocabulary whose ids are its merge ranks, the 256 bytes first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(white(pattern))
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.bytes[r] = t
        self.longest = max(map(len, ranks), default=1)
        self.text = list(map(str, range(len(self.bytes))))
        self.left: list[int] = list(range(len(self.bytes)))
        self.right: list[int] = list(range(len(self.bytes)))
        self._apart: dict[int, bool] = {}
        #: Tokens that merges can make, by their bytes.
        self.made: dict[bytes, int] = {}
        for t, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) == 1 or self._halve(t, r):
                self.made[t] = r
        self._new: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}

    def _halve(self, t: bytes, token: int) -> bool:
        """Finds the two tokens whose merge makes this one; False if merges never make it."""
        for k in range(1, len(t)):
            a, b = self.made.get(t[:k]), self.made.get(t[k:])
            if a is not None and b is not None and self.apart(a, b, token):
                self.left[token], self.right[token] = a, b
                return True
        return False

    def apart(self, a: int, b: int, limit: int = 1 << 62) -> bool:
        """Whether merges of rank below `limit` (all by default) leave token a followed by token b as they are.

        Undoes the later of the two tokens' merges at the boundary, again and again: at each stage the pair that
        meets there must have no merge that would have come before the merge just undone.
        """
        ranks, text, left, right = self.ranks, self.bytes, self.left, self.right
        while True:
            joined = ranks.get(text[a] + text[b])
            if joined is not None and joined < limit:
                return False
            if a > b and right[a] != a:
                limit, a = a, right[a]  # of equal merges the left one comes first
            elif left[b] != b:
                limit, b = b + 1, left[b]
            elif right[a] != a:
                limit, a = a, right[a]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else PrefixTable(self, piece).ids()

    def _kept(self, match: str) -> tuple[int, ...]:
        """A match's ids by the older half of the cache, or made; into the newer half."""
        got = self._old.get(match)
        if got is None:
            got = tuple(self.encode_piece(match.encode()))
        if len(match) <= 64:
            if len(self._new) >= CACHE // 2:
                self._old, self._new = self._new, {}
            self._new[match] = got
        return got

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        kept = self._kept
        out: list[int] = []
        for m in self.pattern.findall(text):
            out += self._new.get(m) or kept(m)
        return out

    def joined(self, ids: list[int]) -> str:
        """Decimal ids, joined by commas."""
        return ",".join(map(self.text.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class PrefixTable:
    """The last token of every prefix of a byte string, for exact appends and re-encoding near edits."""

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        n = len(self.data)
        self.data += more
        self._fill(n + 1, len(self.data) + 1)

    def _fill(self, start: int, end: int) -> None:
        """Adds the last tokens of the prefixes of start to end - 1 bytes."""
        data, last, made, longest = self.data, self.last, self.bpe.made, self.bpe.longest
        known, apart = self.bpe._apart, self.bpe.apart
        if len(known) > PAIRS:
            known.clear()
        for i in range(start, end):
            for j in range(i - longest if i > longest else 0, i):
                t = made.get(data[j:i])
                if t is not None:
                    if j == 0:
                        break
                    pair = last[j] << 24 | t
                    good = known.get(pair)
                    if good is None:
                        good = known[pair] = apart(last[j], t)
                    if good:
                        break
            else:
                raise ValueError("a byte is missing from the vocabulary")
            last.append(t)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces the bytes start to end; returns how many entries were made anew.

        Entries before the edit stay. Behind it an entry depends on as many entries as the longest token has
        bytes: once so many in a row equal the old ones, all later ones do.
        """
        rest, shift = self.last[end + 1 :], len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start + 1 :]
        same = made = 0
        for i in range(start + 1, len(self.data) + 1):
            self._fill(i, i + 1)
            t = self.last[i]
            made += 1
            old = i - shift - end - 1
            same = same + 1 if old >= 0 and i > start + len(new) and rest[old] == t else 0
            if same >= self.bpe.longest:
                self.last += rest[old + 1 :]
                break
        return made

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= len(self.bpe.bytes[self.last[i]])
        return out[::-1]


_loaded: dict[tuple[str, str], Bpe] = {}


def tokenizer(path: str | Callable[[], str], pattern: str) -> Bpe:
    """This process's vocabulary of a file; path may be a function that finds the file where it is called."""
    at = path() if callable(path) else path
    if (at, pattern) not in _loaded:
        _loaded[at, pattern] = Bpe(load_ranks(at), pattern)
    return _loaded[at, pattern]


def encode_docs(docs: DataFrame, path: str | Callable[[], str], pattern: str, keep: list[str], text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """The columns `keep` of docs with ids (token ids, if wanted), n_tokens, ids_sha256 and decoded_sha256."""
    ship(docs.sparkSession)
    docs = docs.select(*keep, docs[text_col].alias("__text"))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "__text"] + ["ids array<int>"] * with_ids + ["n_tokens bigint, ids_sha256 string, decoded_sha256 string"])

    def run(batches):
        bpe = tokenizer(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # so that ids of few texts are held at once
                batch = whole.slice(at, 256)
                flat, n, a, b = [], [], [], []
                for text in batch.column(batch.num_columns - 1):
                    got = bpe.encode(text.as_py() or "")
                    n.append(len(got))
                    a.append(hashlib.sha256(bpe.joined(got).encode()).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(got)).hexdigest())
                    if with_ids:
                        flat += got
                columns = [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                if with_ids:
                    ends = pa.array([0, *accumulate(n)], pa.int32())
                    columns.insert(len(keep), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(["ids"] if with_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"])
        trim()

    return docs.mapInArrow(run, fields)


def vocabulary(name: str) -> Callable[[], str]:
    """Where the installed public vocabularies have a file; looked up in each process."""

    def find() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return find


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_docs(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"], with_ids=False)
