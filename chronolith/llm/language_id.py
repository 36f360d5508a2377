"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds its letters' vectors, each permuted (rolled) by
its place, by elementwise product; a text's vector bundles (adds) those of its n-grams; a language's prototype bundles
all texts labelled with it. A text is given the language whose prototype has the largest cosine with its vector.

The vectors are those of a fixed seed, so every run and every executor has the same. Letters are lower-cased and share
255 vectors by code point; what lies between letters counts as one space. Prototypes are learned from all labelled
texts, by aggregation.

Defined results: a null text, or one without a letter, is `und` with score 0, as is every text if nothing was learned;
of equal cosines the language first in order wins; null labels are not learned from; repeated rows count each; an empty
table gives an empty result; further columns are passed over.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import merged, refuse_clash, ship, table

DIM, GRAM, SEED = 1024, 3, 20240501
#: Characters worked on at once, and n-gram vectors kept at once, in a worker.
CHUNK, KEPT = 1 << 20, 16_384


class Hyper:
    """Letter vectors, and n-gram vectors made when first met."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.letters = (rng.integers(0, 2, (256, DIM)) * 2 - 1).astype(np.float32)
        code = np.zeros(0x110000, dtype=np.uint8)  # 0: no letter
        for cp in range(0x110000):
            c = chr(cp)
            if unicodedata.category(c)[0] == "L":
                low = c.lower()
                code[cp] = 1 + ord(low if len(low) == 1 else c) % 255
        self.code = code
        self._reset()

    def _reset(self):
        self.at = np.zeros(1 << 8 * GRAM, dtype=np.uint16)  # place of an n-gram's vector, plus 1
        self.rows = np.zeros((KEPT, DIM), dtype=np.float32)
        self.used = 0

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """The vectors' places in `rows`, made where they are new. At most KEPT different n-grams."""
        new = grams[self.at[grams] == 0]
        if len(new) + self.used > KEPT:
            self._reset()
            new = grams
        if len(new):
            made = np.ones((len(new), DIM), dtype=np.float32)
            for k in range(GRAM):
                made *= np.roll(self.letters[(new >> (8 * (GRAM - 1 - k))) & 255], GRAM - 1 - k, axis=1)
            self.rows[self.used : self.used + len(new)] = made
            self.at[new] = np.arange(self.used + 1, self.used + len(new) + 1)
            self.used += len(new)
        return self.at[grams].astype(np.int64) - 1

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A whole text's different n-grams and how often each occurs; none if it has no letter."""
        parts = []
        carry = np.zeros(1, dtype=np.uint8)  # a space before the text
        for i in range(0, len(text), CHUNK):
            part = self.code[np.frombuffer(text[i : i + CHUNK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
            part = np.concatenate((carry, part, np.zeros(int(i + CHUNK >= len(text)), dtype=np.uint8)))
            part = part[np.concatenate(([True], (part[1:] != 0) | (part[:-1] != 0)))]  # one space in place of many
            if len(part) >= GRAM:
                g = np.zeros(len(part) - GRAM + 1, dtype=np.int32)
                for k in range(GRAM):
                    g = (g << 8) | part[k : k + len(g)]
                parts.append(np.unique(g, return_counts=True))
                carry = part[-(GRAM - 1) :]
            else:
                carry = part
        if not parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        if len(parts) == 1:
            return parts[0]
        every, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return every, np.bincount(place, weights=np.concatenate([p[1] for p in parts]))

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(DIM)
        for i in range(0, len(grams), KEPT // 4):
            at = self.vectors(grams[i : i + KEPT // 4])
            out += counts[i : i + KEPT // 4].astype(np.float32) @ self.rows[at]
        return out


_hyper: list[Hyper] = []


def hyper() -> Hyper:
    if not _hyper:
        _hyper.append(Hyper())
    return _hyper[0]


def prototypes(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Each language's bundle over all its labelled texts. One vector for each language comes to the driver."""
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def learn(batches):
        h, counts = hyper(), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams, n = h.grams(text.as_py())
                held = counts.setdefault(lang, {})
                held.setdefault("g", []).append(grams)
                held.setdefault("n", []).append(n)
                held["size"] = held.get("size", 0) + len(grams)
                if held["size"] > CHUNK:
                    _merge(held)
        for lang, held in counts.items():
            _merge(held)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "v": pa.array([h.bundle(held["g"][0], held["n"][0]).tobytes()], pa.binary())})

    def add(key, found):
        total = np.sum([np.frombuffer(v.as_py()) for v in found["v"]], axis=0)
        return pa.table({"lang": pa.array([key[0].as_py()]), "v": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(learn, "lang string, v binary")
    return {r["lang"]: np.frombuffer(r["v"]) for r in merged(parts, ["lang"], add, "lang string, v binary").collect()}


def _merge(held: dict) -> None:
    every, place = np.unique(np.concatenate(held["g"]), return_inverse=True)
    held["n"] = [np.bincount(place, weights=np.concatenate(held["n"]), minlength=len(every))]
    held["g"], held["size"] = [every], len(every)


def language_id(docs: DataFrame, learned: dict[str, np.ndarray], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs with lang_pred and score, the cosine with that prototype, 0 to 1. `keep` may not hold `lang_pred` or `score`."""
    refuse_clash(keep, ("lang_pred", "score"))
    ship(docs.sparkSession)
    names = sorted(k for k, v in learned.items() if np.any(v))
    unit = np.array([learned[k] / np.linalg.norm(learned[k]) for k in names]).reshape(len(names), DIM)
    docs = docs.select(*keep, F.col(text_col).alias("__text"))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "__text"] + ["lang_pred string, score double"])

    def run(batches):
        h = hyper()
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(batch.num_columns - 1):
                grams, n = h.grams(text.as_py() or "")
                v = h.bundle(grams, n)
                size = np.linalg.norm(v)
                cos = unit @ v / size if len(names) and size > 0 and np.any(grams) else None
                best = int(np.argmax(cos)) if cos is not None else -1
                langs.append(names[best] if best >= 0 else "und")
                scores.append(float(min(1.0, max(0.0, cos[best]))) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return docs.mapInArrow(run, fields)


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(k)).cast("int")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = prototypes(docs.where(fold("doc_id", 4) != 2).select("text", "lang"))
    out = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return language_id(out, learned, ["doc_id", "held_out"])
