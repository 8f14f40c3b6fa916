"""Quality rules: counted features and the perplexity of a modified Kneser-Ney bigram model.

Spark counts the bigrams of all documents, language by language: tasks count their own part, send
packed counts to shards by the hash of the first word, and a shard sums them.  As Kneser-Ney asks
below the highest order, a bigram counts by the different words before it, so passages that are
copied from document to document count once; a 16-bit sketch beside the plain count tells how many
there are, and once it is full the plain count stands.  The model is kept whole in sorted hash
arrays (Arrow files, memory-mapped by the tasks that score): bigram to count, history to its total
and its counts of counts, word to its number of different histories.  The three discounts of either
order come from the language's counts of counts (Chen and Goodman, 1999).  An array has a directory
by the leading bits of its keys, about one entry in sixteen keys, and of each key the 32 bits after
them, so a bigram takes about five bytes and two keys are alike once in some 10^8.

A document is scored by its own language's model, and the band of log perplexities kept is the
median of the language's documents less `lower_width` and plus `width` robust deviations (1.4826
times the median deviation on that side, `least_deviation` at least); documents above or below are
rejected.  Rows alike in all features and the perplexity, as copies are, count once when the band is
set.

Null and empty texts have no words and fail the base rules; a null language is a language of its
own; repeated rows count and are judged each; an empty table gives an empty result; other columns
of the input are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encode_words, filesystem, hash_words, materialise, open_mapped, scratch, steps

#: Words are known by 40 bits of their hash, mixed with their language's.
_BITS = np.uint64(24)
_START = 0
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SYMBOLS = np.zeros(256, np.uint8)
_SYMBOLS[list(b"#*$%&|<>")] = 1
#: Values of what was counted once: a count, or a history's total and its counts of 1, 2 and more.
_ONCE = (1, 1, 0, 0)
#: Different bigrams that a task holds before it sends them on.
_MOST_HELD = 3_000_000


def _bigram_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (v * _MUL) ^ (w << np.uint64(17)) ^ w
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _id_key(ids: np.ndarray) -> np.ndarray:
    """Ids of words with their 40 bits in front, as keys of an array."""
    return ids << _BITS


def _history_key(v: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Keys of histories; all languages have the start, whose key is its language's."""
    return np.where(v == _START, salt * _MUL, _id_key(v))


def _pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns as byte planes, compressed."""
    planes = b"".join(np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes() for c, n in columns)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(blob: bytes, rows: list[int], widths: list[int]) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(blob, sum(r * w for r, w in zip(rows, widths)), codec="zstd"), np.uint8)
    out, at = [], 0
    for r, w in zip(rows, widths):
        full = np.zeros((r, 8), np.uint8)
        full[:, :w] = planes[at : at + r * w].reshape(w, r).T
        out.append(full.reshape(-1).view("<u8"))
        at += r * w
    return out


def _salt(langs: list[str | None]) -> np.ndarray:
    return hash_words(pa.array(["" if x is None else f"l{x}" for x in langs], pa.string()))


def _word_ids(text: pa.Array, langs: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words, the texts' offsets, the words' rows and their indices among the step's words."""
    distinct, index, offsets = encode_words(text)
    row = np.repeat(np.arange(len(langs)), np.diff(offsets))
    return ((hash_words(distinct)[index] ^ _salt(langs)[row]) * _MUL) >> _BITS, offsets, row, index


def _histories(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    v = np.concatenate((np.zeros(1, np.uint64), ids[:-1])) if len(ids) else ids
    v[offsets[:-1][np.diff(offsets) > 0]] = _START
    return v


def _count(docs: DataFrame, shards: int, some: range | None = None) -> DataFrame:
    """(shard, lang, n, m, u, data): packed bigram counts of the shards `some` (all if None), the rows
    of a blob in order of the history."""
    some = range(shards) if some is None else some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, ...]]] = {}
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                v, w, c, before = _summed(parts)
                of = v % np.uint64(shards)
                out: list[tuple] = []
                for s in np.unique(of):
                    pick = of == s
                    out.append((int(s), lang, *_packed_counts(v[pick], w[pick], c[pick], before[pick])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["shard", "lang", "n", "m", "u", "data"])
            held.clear()

        for b in steps(batches):
            langs = b.column("lang").to_pylist()
            ids, offsets, row, _ = _word_ids(b.column("text"), langs)
            v = _histories(ids, offsets)
            before = np.uint64(1) << (_bigram_key(_histories(v, offsets), v) & np.uint64(15))
            of = v % np.uint64(shards)
            asked = (of >= some.start) & (of < some.stop)
            for lang in set(langs):
                pick = np.array([x == lang for x in langs])[row] & asked
                if pick.any():
                    part = _summed([(v[pick], ids[pick], np.ones(int(pick.sum()), np.int64), before[pick])])
                    held.setdefault(lang, []).append(part)
                    size += len(part[0])
            if size > _MOST_HELD:
                yield from send()
                size = 0
        yield from send()

    return docs.mapInArrow(run, "shard bigint, lang string, n bigint, m bigint, u bigint, data binary")


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct (v, w) in order, with the sums of their counts and their joined sketches."""
    v, w, c, before = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((w, v))
    v, w, c, before = v[order], w[order], c[order], before[order]
    new = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))
    return v[new], w[new], np.add.reduceat(c, new), np.bitwise_or.reduceat(before, new)


def _different(c: np.ndarray, before: np.ndarray) -> np.ndarray:
    """About how many different words stood before, from the sketch; the plain count where it is full."""
    bits = np.bitwise_count(before).astype(np.int64)
    some = np.round(-16 * np.log1p(-np.minimum(bits, 15) / 16)).astype(np.int64)
    return np.where(bits == 16, c, np.minimum(c, some))


def _packed_counts(v: np.ndarray, w: np.ndarray, c: np.ndarray, before: np.ndarray) -> tuple[int, int, int, bytes]:
    """Rows, histories and words of a blob, and the blob: ascending ids as steps, rows by the words'
    places, which ascend within a history and are steps there."""
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    runs = np.diff(np.append(first, len(v)))
    words, place = np.unique(w, return_inverse=True)
    _small(c)  # packed in four bytes below
    steps_of = [(np.diff(x, prepend=np.uint64(0)), 5) for x in (v[first], words)]
    further = np.diff(place, prepend=0)
    further[first] = place[first]
    return len(v), len(first), len(words), _pack(steps_of[0], (runs, 4), steps_of[1], (further, 4), (c, 4), (before, 2))


def _unpacked_counts(n: int, m: int, u: int, data: bytes) -> tuple[np.ndarray, ...]:
    v, runs, words, further, c, before = _unpack(data, [m, m, u, n, n, n], [5, 4, 5, 4, 4, 2])
    runs, upto = runs.astype(np.int64), np.concatenate(([0], np.cumsum(further, dtype=np.int64)))
    place = upto[1:] - np.repeat(upto[np.cumsum(runs) - runs], runs)
    return np.repeat(np.cumsum(v, dtype=np.uint64), runs), np.cumsum(words, dtype=np.uint64)[place], c.astype(np.int64), before


def _small(x: np.ndarray) -> np.ndarray:
    """`x` in four bytes; an error if a count does not fit, as it would come back as a lesser one."""
    if len(x) and int(x.max()) >> 32:
        raise OverflowError(f"a count of {int(x.max())} does not fit in 32 bits")
    return x.astype(np.uint32)


def _bucketed(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading `bits` bits of keys, and the 32 bits after them."""
    return (key >> np.uint64(64 - bits)).astype(np.int64), (key >> np.uint64(32 - bits)).astype(np.uint32)


def _write_array(folder: str, kind: str, shard: int, key: np.ndarray, values: dict[str, np.ndarray]) -> str:
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    order = np.argsort(key)
    bits = max(1, (len(key) // 16).bit_length() - 1)
    bucket, low = _bucketed(key[order], bits)
    columns = {"directory": _small(np.searchsorted(bucket, np.arange((1 << bits) + 1))), "key": low, **{k: x[order] for k, x in values.items()}}
    # one row, as the columns differ in length
    table = pa.table({k: pa.LargeListArray.from_arrays(pa.array([0, len(x)], pa.int64()), pa.array(x)) for k, x in columns.items()})
    name = f"{kind}-{shard:05d}-{uuid.uuid4().hex}.arrow"
    with system.open_output_stream(f"{path}/{name}") as sink, pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    return f"{folder}/{name}"


def _write_arrays(folder: str, kind: str, shard: int, key: np.ndarray, **values: np.ndarray) -> list[tuple[str, str]]:
    """(kind, file) of the rows of `_ONCE`, as keys alone, those whose values fit in a byte, and the others."""
    once = np.all([x == v for x, v in zip(values.values(), _ONCE)], axis=0)
    narrow = np.all([x < 256 for x in values.values()], axis=0)
    out = []
    for name, rows, kept, width in ((f"once_{kind}", once, {}, None), (kind, narrow & ~once, values, np.uint8), (f"large_{kind}", ~narrow, values, np.uint64)):
        if rows.any():
            out.append((name, _write_array(folder, name, shard, key[rows], {k: x[rows].astype(width) for k, x in kept.items()})))
    return out


def _found(directory: np.ndarray, low: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in an array, and whether it is there."""
    bucket, wanted = _bucketed(key, (len(directory) - 1).bit_length() - 1)
    at, end = (directory[x].astype(np.int64) for x in (bucket, bucket + 1))
    stop = end
    for _ in range(int((end - at).max(initial=0)).bit_length()):
        middle = (at + stop) >> 1
        less = (at < stop) & (low[np.minimum(middle, len(low) - 1)] < wanted)
        at, stop = np.where(less, middle + 1, at), np.where(less, stop, np.minimum(middle, stop))
    return at, (at < end) & (low[np.minimum(at, len(low) - 1)] == wanted)


_FILES = "kind string, shard bigint, uri string, lang string, n1 bigint, n2 bigint, n3 bigint, n4 bigint, total bigint, distinct bigint, n bigint, data binary"


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def _merge_bigrams(folder: str, shards: int):
    """Sums a shard's counts; writes its arrays; passes on how many histories its words have."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard, out, bigrams, histories = int(rows["shard"].iloc[0]), [], [], []
        for lang, part in rows.groupby("lang", dropna=False):
            lang = None if pd.isna(lang) else lang
            v, w, c, before = _summed([_unpacked_counts(*x) for x in zip(part["n"], part["m"], part["u"], part["data"])])
            c = _different(c, before)
            first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            sums = [np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c >= 3)]
            histories.append((_history_key(v[first], _salt([lang])), *sums))
            bigrams.append((_bigram_key(v, w), c))
            out.append(("bigram", shard, None, lang, *_counts_of_counts(c), int(c.sum()), len(c), 0, None))
            u, n = np.unique(w, return_counts=True)
            for s in np.unique(u % np.uint64(shards)):
                pick = u % np.uint64(shards) == s
                out.append(("word", int(s), None, lang, 0, 0, 0, 0, 0, 0, int(pick.sum()), _pack((np.diff(u[pick], prepend=np.uint64(0)), 5), (n[pick], 4))))
        key, c = (np.concatenate(x) for x in zip(*bigrams))
        files = _write_arrays(folder, "bigrams", shard, key, c=c)
        key, total, n1, n2, n3 = (np.concatenate(x) for x in zip(*histories))
        files += _write_arrays(folder, "histories", shard, key, total=total, n1=n1, n2=n2, n3=n3)
        out += [(kind, shard, uri, None, 0, 0, 0, 0, 0, 0, 0, None) for kind, uri in files]
        return pd.DataFrame(out, columns=[f.split()[0] for f in _FILES.split(", ")])

    return run


def _merge_words(folder: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard, out, words = int(rows["shard"].iloc[0]), [], []
        for lang, part in rows.groupby("lang", dropna=False):
            lang = None if pd.isna(lang) else lang
            unpacked = [_unpack(data, [n, n], [5, 4]) for n, data in zip(part["n"], part["data"])]
            w, c = np.concatenate([np.cumsum(x, dtype=np.uint64) for x, _ in unpacked]), np.concatenate([x for _, x in unpacked]).astype(np.int64)
            order = np.argsort(w, kind="stable")
            w, c = w[order], c[order]
            new = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            w, c = w[new], np.add.reduceat(c, new)
            out.append(("unigram", shard, None, lang, *_counts_of_counts(c), int(c.sum()), len(c), 0, None))
            words.append((_id_key(w), c))
        key, c = (np.concatenate(x) for x in zip(*words))
        out += [(kind, shard, uri, None, 0, 0, 0, 0, 0, 0, 0, None) for kind, uri in _write_arrays(folder, "words", shard, key, c=c)]
        return pd.DataFrame(out, columns=[f.split()[0] for f in _FILES.split(", ")])

    return run


def _discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [0.0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    d = [min(max(x, 0.0), float(i)) for i, x in enumerate(d)]
    return np.array(d)


class Model:
    """The sorted hash arrays, and each language's discounts and totals."""

    def __init__(self, files: dict[str, dict[int, str]], languages: dict[str | None, dict[str, tuple]], shards: int):
        self.files, self.shards = files, shards
        self.languages = {}
        for lang, of in languages.items():
            (*n, _, _), (*u, histories, vocabulary) = of["bigram"], of["unigram"]
            low = _discounts(u)
            spare = float(low[1] * u[0] + low[2] * u[1] + low[3] * (vocabulary - u[0] - u[1])) / histories
            self.languages[lang] = (_discounts(n), low, histories, spare / (vocabulary + 1))
        self.opened: dict[tuple[str, int], list[np.ndarray] | None] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"opened": {}}

    def _array(self, kind: str, shard: int) -> list[np.ndarray] | None:
        if (kind, shard) not in self.opened:
            uri = self.files.get(kind, {}).get(shard)
            table = pa.ipc.open_file(open_mapped(uri)).read_all() if uri else None
            self.opened[kind, shard] = [c.chunk(0).values.to_numpy() for c in table.columns] if table else None
        return self.opened[kind, shard]

    def _look_up(self, kind: str, shard: np.ndarray, key: np.ndarray, missing: list[int]) -> list[np.ndarray]:
        """The values of each key in its shard's array, or `missing`."""
        out = [np.full(len(key), m, np.float64) for m in missing]
        order = np.lexsort((key, shard))
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in range(self.shards):
            rows = order[cuts[s] : cuts[s + 1]]
            for name in (f"once_{kind}", kind, f"large_{kind}"):
                held = self._array(name, s) if len(rows) else None
                if held is None:
                    continue
                at, hit = _found(*held[:2], key[rows])
                for k, o in enumerate(out):
                    o[rows[hit]] = held[2 + k][at[hit]] if held[2:] else _ONCE[k]
                rows = rows[~hit]
        return out

    def log_probabilities(self, v: np.ndarray, w: np.ndarray, lang: list[str | None], row: np.ndarray) -> np.ndarray:
        """Natural logarithms of p(w | v), word by word; `lang` is per row."""
        n = np.uint64(self.shards)
        pairs, back = np.unique(_bigram_key(v, w), return_index=True, return_inverse=True)[1:]
        v, w, of = v[pairs], w[pairs], row[pairs]
        (c,) = self._look_up("bigrams", (v % n).astype(np.int64), _bigram_key(v, w), [0])
        total, n1, n2, n3 = self._look_up("histories", (v % n).astype(np.int64), _history_key(v, _salt(lang)[of]), [0, 0, 0, 0])
        (cont,) = self._look_up("words", (w % n).astype(np.int64), _id_key(w), [0])
        default = (np.array([0.0, 1.0, 1.0, 1.5]), np.array([0.0, 0.5, 1.0, 1.5]), 1, 0.5)
        table = [self.languages.get(x, default) for x in lang]
        high, low = np.stack([t[0] for t in table]), np.stack([t[1] for t in table])
        histories, floor = np.array([t[2] for t in table], float), np.array([t[3] for t in table])
        lower = (cont - low[of, np.minimum(cont, 3).astype(int)]).clip(0) / histories[of] + floor[of]
        spare = high[of, 1] * n1 + high[of, 2] * n2 + high[of, 3] * n3
        some = total > 0
        p = lower.copy()
        p[some] = (c - high[of, np.minimum(c, 3).astype(int)]).clip(0)[some] / total[some] + spare[some] / total[some] * lower[some]
        return np.log(p)[back]


def train(docs: DataFrame, shard_bytes: int = 64 << 20, passes: int = 2) -> Model:
    """Count the bigrams of `docs` (lang, text) and write the model's arrays to the shared folder.

    A shard has the bigrams of about `shard_bytes` of text or less, so that it fits in a task.  The
    shards are counted in `passes` over the texts, so that not all counts are on disk at a time.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    folder = scratch(spark, "language-model")
    cuts = [shards * k // passes for k in range(passes + 1)]
    parts = [_count(docs, shards, range(a, b)).groupBy("shard").applyInPandas(_merge_bigrams(folder, shards), _FILES) for a, b in zip(cuts, cuts[1:])]
    merged = reduce(DataFrame.unionByName, [materialise(part, "bigrams") for part in parts])
    words = merged.where("kind = 'word'").groupBy("shard").applyInPandas(_merge_words(folder), _FILES)
    words = materialise(words, "words").select("kind", "shard", "uri", "lang", "n1", "n2", "n3", "n4", "total", "distinct")
    both = merged.where("kind <> 'word'").select(*words.columns).unionByName(words)
    files: dict[str, dict[int, str]] = {}
    for r in both.where("uri is not null").select("kind", "shard", "uri").collect():  # a row a shard
        files.setdefault(r.kind, {})[r.shard] = r.uri
    sums = [F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "total", "distinct")]
    languages: dict[str | None, dict[str, tuple]] = {}
    for r in both.where("uri is null").groupBy("lang", "kind").agg(*sums).collect():  # a row a language
        languages.setdefault(r.lang, {})[r.kind] = (r.n1, r.n2, r.n3, r.n4, r.total, r.distinct)
    return Model(files, languages, shards)


def _base(text: pa.Array, distinct_index: np.ndarray, offsets: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    rows = len(text)
    texts = pc.fill_null(text, "")
    n_words = np.diff(offsets)
    whole = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = texts.cast(pa.large_binary()) if not pa.types.is_large_string(texts.type) else texts
    bounds = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + rows + 1]
    data = np.frombuffer(lists.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if lists.buffers()[2] else np.empty(0, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[bounds - bounds[0]])

    dup = np.zeros(rows, np.int64)
    for i, t in enumerate(texts.to_pylist()):
        lines = t.split("\n")
        if len(lines) > 1:
            seen = set()
            for line in lines:
                if line in seen:
                    dup[i] += 1
                elif line.strip(" \t\x0b\x0c\r"):
                    seen.add(line)
    n = len(distinct_index)
    covered = np.zeros(n, bool)
    if n > 2:
        x = distinct_index.astype(np.uint64) + np.uint64(1)
        key = _bigram_key(_bigram_key(x[:-2], x[1:-1]), x[2:]) ^ _bigram_key(row[:-2].astype(np.uint64), np.full(n - 2, 7, np.uint64))
        inside = np.flatnonzero(row[2:] == row[:-2])
        key = key[inside]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        for j in range(3):
            covered[inside[twice] + j] = True
    return [n_words, whole - per_text(space), per_text(_SYMBOLS[data]), dup, np.bincount(row[covered], minlength=rows)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, features..., log_perplexity) of `docs` (doc_id, lang, text)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            langs = b.column("lang").to_pylist()
            ids, offsets, row, index = _word_ids(b.column("text"), langs)
            features = _base(b.column("text"), index, offsets, row)
            total = np.zeros(len(langs))
            if len(ids):
                total = np.bincount(row, model.log_probabilities(_histories(ids, offsets), ids, langs, row), len(langs))
            entropy = -total / np.maximum(features[0], 1)
            columns = [pa.array(x.astype(np.int64)) for x in features] + [pa.array(entropy, mask=features[0] == 0)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *columns], ["doc_id", "lang", *names, "log_perplexity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, lang string, " + "".join(f"{c} bigint, " for c in names) + "log_perplexity double")


def quality(docs: DataFrame, width: float = 6.0, least_deviation: float = 0.1, lower_width: float = 3.0) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    perplexity, lower, upper) for every row of `docs` (doc_id, lang, text)."""
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = materialise(score(docs, train(docs)).withColumn("base_failed", failed), "scores")
    sound = scored.where("not base_failed").drop("doc_id").distinct()  # copies have the same features and count once
    middle = sound.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("middle"))
    off = sound.alias("s").join(middle.alias("m"), F.col("s.lang").eqNullSafe(F.col("m.lang"))).select("s.lang", "middle", (F.col("log_perplexity") - F.col("middle")).alias("off"))
    sides = [F.percentile_approx(F.when(x >= 0, x), 0.5, 10000).alias(side) for side, x in (("below", -F.col("off")), ("above", F.col("off")))]
    spread = off.groupBy("lang").agg(F.first("middle").alias("middle"), *sides)
    below, above = (w * F.greatest(1.4826 * F.col(side), F.lit(least_deviation)) for w, side in ((lower_width, "below"), (width, "above")))
    bands = spread.select(F.col("lang").alias("of"), F.exp(F.col("middle") - below).alias("lower"), F.exp(F.col("middle") + above).alias("upper"))
    judged = scored.join(bands, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("perplexity", F.exp("log_perplexity"))
    fits = F.coalesce(F.col("perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*names, (~F.col("base_failed") & fits).alias("kept"), "perplexity", "lower", "upper")
