"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from the letter and a seed.
Three letters in a row are bound into one vector: the first one's, shifted by
two places, times the second one's, shifted by one, times the third one's. A
text's vector is the sum over its trigrams, a language's prototype that over its
texts, each scaled to length one. Texts take the language of the prototype with
the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.words import BLOCK_BYTES, blocks

DIMENSIONS, SEED = 1024, 7
UNKNOWN = "und"
#: Letter vectors and trigram vectors that a worker remembers.
REMEMBERED_LETTERS, REMEMBERED_TRIGRAMS = 4_096, 16_384
#: Trigrams that are multiplied at once.
_PART = 4_096
#: Labels that are learned at most; sums of so many languages are held by a task.
MOST_LANGUAGES, HELD_LANGUAGES = 20_000, 1_000
_BLANK = 32


class Encoder:
    """Turns texts into vectors; the same for every process."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.table = np.empty((REMEMBERED_TRIGRAMS, dimensions), np.int8)
        self.is_letter = np.zeros(0x110000, np.uint8)  # 0: not looked at yet, 1: no, 2: yes

    def letter(self, code: int) -> np.ndarray:
        got = self.letters.get(code)
        if got is None:
            if len(self.letters) >= REMEMBERED_LETTERS:
                self.letters.clear()
            bits = np.random.Generator(np.random.Philox(key=[self.seed, code])).integers(0, 2, self.dimensions, np.int8)
            got = self.letters[code] = (2 * bits - 1).astype(np.int8)
        return got

    def bound(self, trigram: int) -> np.ndarray:
        a, b, c = trigram >> 42, trigram >> 21 & 0x1FFFFF, trigram & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts: owners, trigrams (21 bits a letter) and counts. Letters are lower-cased; runs of other characters are one blank."""
        joined = "\x00".join(texts).lower()
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = codes == 0
        owner = np.cumsum(ends)
        kinds = self.is_letter[codes]
        for code in np.unique(codes[kinds == 0]):
            self.is_letter[code] = 2 if chr(code).isalpha() else 1
        letter = self.is_letter[codes] == 2
        codes = np.where(letter, codes, _BLANK)
        keep = letter | ends
        keep[1:] |= letter[:-1]
        if len(keep):
            keep[0] = True
        codes, owner, ends, letter = codes[keep], owner[keep], ends[keep], letter[keep]
        # a text is framed by blanks: the mark between texts stands for both, or each has its own
        tri = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
        middle = letter[1:-1]  # trigrams around a letter
        own = owner[1:-1]
        tri, own = tri[middle], own[middle]
        order = np.lexsort((tri, own))
        tri, own = tri[order], own[order]
        first = np.ones(len(tri), bool)
        first[1:] = (tri[1:] != tri[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(first)
        return own[at], tri[at], np.diff(np.append(at, len(tri)))

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A vector for each text, scaled to length one, and whether it has a letter at all."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        own, tri, count = self.trigrams([t.replace("\x00", " ") + " " for t in [" " + t for t in texts]]) if texts else (np.empty(0, int),) * 3
        for low in range(0, len(texts), 64):
            a, b = np.searchsorted(own, [low, low + 64])
            kinds, place = np.unique(tri[a:b], return_inverse=True)
            for at in range(0, len(kinds), _PART):
                part = kinds[at : at + _PART]
                inside = (place >= at) & (place < at + len(part))
                counts = np.zeros((min(64, len(texts) - low), len(part)), np.float32)
                counts[own[a:b][inside] - low, place[inside] - at] = count[a:b][inside]
                out[low : low + 64] += counts @ self.rows(part)
        length = np.linalg.norm(out, axis=1)
        some = np.zeros(len(texts), bool)
        some[own] = True
        return out / np.maximum(length, 1e-9)[:, None], some

    def rows(self, kinds: np.ndarray) -> np.ndarray:
        """Vectors of these trigrams."""
        listed = kinds.tolist()
        missing = [k for k in listed if k not in self.row]
        if len(self.row) + len(missing) > REMEMBERED_TRIGRAMS:
            self.row.clear()
            missing = listed
        for k in missing:
            self.table[len(self.row)] = self.bound(k)
            self.row[k] = len(self.row)
        return self.table[[self.row[k] for k in listed]].astype(np.float32)


_encoders: dict[tuple[int, int], Encoder] = {}


def encoder(dimensions: int, seed: int) -> Encoder:
    """This process's encoder."""
    if (dimensions, seed) not in _encoders:
        _encoders[dimensions, seed] = Encoder(dimensions, seed)
    return _encoders[dimensions, seed]


def _share(known: DataFrame, per_language: int | None, most: int, seed: int) -> DataFrame:
    """All rows of each label of known (lang, text, key), or about per_language of them: those whose key's hash is below the share of its rows that this is.

    Of more than ``most`` labels those with the most rows are taken. Labels meet by hash,
    in a table of at most ``most`` pairs of numbers, so it can be sent to all executors.
    """
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    share = F.lit(1 << 31) if per_language is None else F.least(F.lit(1 << 31), F.ceil(F.lit(per_language << 31) / F.col("n")))
    counts = counts.select(F.xxhash64("lang").alias("_label"), share.alias("_share"))
    place = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 31))
    return known.join(F.broadcast(counts), F.xxhash64("lang") == F.col("_label")).where(place < F.col("_share")).select("lang", "text")


def _labelled(docs: DataFrame, text: str, lang: str, key: str) -> DataFrame:
    return docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))


_SUM = "lang string, v array<double>"


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each language's vectors, from rows sorted by language."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        made = batch["v"].flatten().to_numpy().reshape(len(batch), -1)
        for name, v in zip(batch["lang"].to_pylist(), made):
            if name in held:
                held[name] = held[name] + v
            else:
                yield from _vectors(held)
                held = {name: v}
    yield from _vectors(held)


def _vectors(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])


def train(
    labelled: DataFrame, per_language: int | None = None, most: int = MOST_LANGUAGES, text: str = "text", lang: str = "lang", key: str = "doc_id", dimensions: int = DIMENSIONS, seed: int = SEED
) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from all labelled rows.

    With per_language about so many rows of each language are taken (all, if it has
    fewer): those whose key's hash is below the share of the language's rows that this
    is; of more than ``most`` labels, those with the most rows. Rows without a label or a letter teach nothing. Each task adds up its rows, a thousand
    languages at a time; the sums are added up by Spark. The driver gets a vector for
    each language: ``most`` times ``dimensions`` numbers at most.
    """
    sample = _share(_labelled(labelled, text, lang, key), per_language, most, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sums = encoder(dimensions, seed), {}
        for batch in batches:
            for a, b in blocks(batch["text"], BLOCK_BYTES):
                made, some = coder.vectors(batch["text"][a:b].fill_null("").to_pylist())
                for name, v, ok in zip(batch["lang"][a:b].to_pylist(), made, some):
                    if ok:
                        sums[name] = sums.get(name, 0) + v.astype(np.float64)
                        if len(sums) >= HELD_LANGUAGES:
                            yield from _vectors(sums)
                            sums = {}
        yield from _vectors(sums)

    sums = sample.mapInArrow(run, _SUM).repartition("lang").sortWithinPartitions("lang").mapInArrow(_sum_up, _SUM)
    rows = sums.select("lang", F.transform("v", lambda x: x.cast("float")).alias("v")).toArrow().sort_by("lang")  # most languages x dimensions
    names = rows["lang"].to_pylist()
    table = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(names), dimensions)
    return names, table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)


def nearest(made: np.ndarray, table: np.ndarray, at_once: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """For each vector its nearest prototype, the first of equal ones, and their cosine; so many cosines at once."""
    best, cosine = np.zeros(len(made), np.int64), np.zeros(len(made), np.float32)
    step = max(1, at_once // max(1, len(table)))
    for i in range(0, len(made), step):
        part = made[i : i + step] @ table.T
        best[i : i + step] = part.argmax(axis=1)
        cosine[i : i + step] = part.max(axis=1)
    return best, cosine


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """docs with lang_pred and score after its columns; columns of these names are replaced.

    score is the cosine with the language's prototype, 0 if it is negative. Texts
    that are null or have no letter get ``und`` and 0, as do all texts if the model
    has learned nothing. Of prototypes with equal cosines the first by code point
    wins. Long texts are used whole. Repeated rows and null keys are predicted like
    others. Nothing is shuffled; prototypes, of a size that the number of languages
    bounds, go with the task.
    """
    names, table = model
    del key
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(dimensions, seed)
        for batch in batches:
            for a, b in blocks(batch[text], BLOCK_BYTES):
                made, some = coder.vectors(batch[text][a:b].fill_null("").to_pylist())
                if names:
                    best, cosine = nearest(made, table)
                    score = np.where(some, np.clip(cosine, 0, 1), 0).astype(np.float64)
                    lang = [names[i] if ok else UNKNOWN for i, ok in zip(best, some)]
                else:
                    score, lang = np.zeros(b - a), [UNKNOWN] * (b - a)
                yield pa.RecordBatch.from_arrays([*(batch[c][a:b] for c in rest), pa.array(lang, pa.string()), pa.array(score)], names=[*rest, "lang_pred", "score"])

    return docs.select(*rest).mapInArrow(run, f"{kinds}, lang_pred string, score double")


#: Letters from which on texts have limits of their own; shorter texts are never rejected for their score.
LENGTHS = (20, 50, 100, 200, 500, 2000)
#: The score that a text in no learned language may reach by chance: 4.5 times the noise of 1,024 random places.
CHANCE = 0.14


def limits(labelled: DataFrame, model: tuple[list[str], np.ndarray], per_language: int | None = None, most: int = MOST_LANGUAGES, least: int = 50, text: str = "text", lang: str = "lang", key: str = "doc_id", seed: int = SEED) -> dict[tuple[str, int], float]:
    """The least score that a text predicted as a language should have, for each language and class of length.

    Half of the score that 95 of 100 rows labelled and predicted as that language
    reach, from the rows that train() takes; CHANCE at least, and CHANCE alone
    where fewer than ``least`` rows tell.
    """
    sample = _share(_labelled(labelled, text, lang, key), per_language, most, seed).withColumnRenamed("lang", "label")
    scored = predict(sample, model, text="text", seed=seed).where("label = lang_pred")
    letters = F.regexp_count("text", F.lit(r"\p{L}"))
    bands = F.array(*map(F.lit, LENGTHS))
    scored = scored.withColumn("band", F.array_max(F.filter(bands, lambda x: x <= letters)))
    rows = scored.where("band IS NOT NULL").groupBy("label", "band").agg(F.percentile_approx("score", 0.05, 10_000).alias("low"), F.count(F.lit(1)).alias("n")).collect()  # languages x lengths
    return {(r["label"], r["band"]): max(CHANCE, r["low"] / 2) for r in rows if r["n"] >= least}


def known_only(docs: DataFrame, model: tuple[list[str], np.ndarray], lower: dict[tuple[str, int], float], text: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """docs without rows whose text is null, has no letter or is in no language of the model.

    The last: it has LENGTHS[0] letters or more and scores below the limit of the
    language it is nearest to, for its length, or below CHANCE where there is none.
    A model that has learned nothing rejects only texts without letters. Repeated
    rows are judged alike, an empty table stays empty, and all columns stay as they are.
    """
    names, table = model
    bands = np.array(LENGTHS)
    highest = max([CHANCE, *lower.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(dimensions, seed)
        for batch in batches:
            for a, b in blocks(batch[text], BLOCK_BYTES):
                texts = batch[text][a:b].fill_null("").to_pylist()
                made, keep = coder.vectors(texts)
                if names:
                    best, cosine = nearest(made, table)
                    for i in np.flatnonzero(keep & (cosine < highest)):
                        band = int(np.searchsorted(bands, sum(map(str.isalpha, texts[i])), "right")) - 1
                        keep[i] = band < 0 or cosine[i] >= lower.get((names[best[i]], LENGTHS[band]), CHANCE)
                yield batch.slice(a, b - a).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id", folds: int = 5):
    """Whether a row is kept from training: crc32 of its key as text, modulo folds, is 0. A null key is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))
