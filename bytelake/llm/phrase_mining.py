"""Phrase collocation mining by multikey three-way quicksort of suffix pointers.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words.  Each word position is a
suffix whose symbols are its language and the next four words of its piece.

1. Words.  Each language's words are counted (partial counts per task); a word's 64-bit id is checked to be its own.
2. Pairs.  Pairs are counted by slot of a table of 2^bits bits, a size given by a parameter.  It only shortens suffixes that can't
   be frequent; pairs that share a slot by chance cost work, never a result.
3. Routing.  A suffix is cut before its first infrequent pair, equal suffixes of a chunk become one weighted pointer, and pointers are
   routed by language and three leading words (a pair's own count by its two), so a hot word or pair is spread over many groups.
4. Quicksort.  Each group's pointers are split by symbol into less, equal and more.  The weight of an equal part is the count of its
   prefix; parts under the least count are abandoned, equal parts are split by their next symbol to four words at most.
5. Scores.  Counts of first and last parts and of longer phrases come from equi-joins on word ids; words are put back for the ranked.

Defined results: a null text counts as empty, a null language as ``und``; repeated rows count each; ties rank by count, then phrase
(UTF-8 bytes); an empty table, or one without frequent phrases, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored
from .registry import query, table

LONGEST = 4
LEAST = 30
COVERED = 80  # per cent of a phrase's occurrences that lie in one longer phrase
TOP = 2000
BITS = 26
PART = 15  # slots are counted in parts of 2^15
CHUNK_BYTES = 32 << 20
SALTS = 64
GROUPS_PER_PARTITION = 4

_STOPS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b".........")
_W = ["w1", "w2", "w3", "w4"]


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in order, with ``.`` (never part of a word) between pieces."""
    return text.lower().translate(_STOPS).replace(b".", b" . ").split()


def word_id(word: bytes, salt: bytes = b"") -> int:
    """A word's id as a signed long (Spark's ``xxhash64`` of the word and the salt); 0 stands for no word."""
    h = xxhash.xxh64_intdigest(word + salt, 42) or 1
    return h - (1 << 64) if h >> 63 else h


def _encoded(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """``(codes, words)`` of all tokens of the texts; code of ``.`` is 0.  Only a few texts' tokens are objects at any time."""
    known: dict[bytes, int] = {b".": 0}
    out, held, size = [], [], 0

    def encode():
        found = pa.array(tokens(b".".join(held)) + [b"."], pa.binary()).dictionary_encode()
        codes = np.array([known.setdefault(w, len(known)) for w in found.dictionary.to_pylist()], np.int32)
        out.append(codes[found.indices.to_numpy()])
        held.clear()

    for text in texts:
        held.append(text)
        size += len(text)
        if size >= 1 << 20:
            encode()
            size = 0
    encode()
    return np.concatenate(out), list(known)


def _map_languages(docs: DataFrame, fn: Callable[[str, list[bytes]], tuple], schema: str) -> DataFrame:
    """``fn(language, texts)`` over chunks of about CHUNK_BYTES of ``docs (_lang, _t binary)``; it returns columns in ``schema`` order."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def flush(held) -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            columns = [pa.array(c, f.type) for c, f in zip(fn(lang, texts), arrow, strict=True)]
            whole = pa.RecordBatch.from_arrays(columns, schema=arrow)
            for at in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(at, 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                held.setdefault(lang.as_py(), []).append(text.as_py())
                size += len(held[lang.as_py()][-1])
                if size >= CHUNK_BYTES:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    return docs.mapInArrow(run, schema)


def _word_counts(lang: str, texts: list[bytes]):
    codes, words = _encoded(texts)
    n = np.bincount(codes, minlength=len(words))
    return [lang] * (len(words) - 1), words[1:], n[1:]


def _salted_id(salt: bytes):
    found = F.xxhash64(F.concat(F.col("word"), F.lit(bytearray(salt))))
    return F.when(found == 0, F.lit(1).cast("long")).otherwise(found)


def _word_table(docs: DataFrame, salt: bytes = b"") -> tuple[DataFrame, bytes]:
    """``(_lang, word, f, id)`` of all words, and the salt under which no two words share an id."""
    words = _map_languages(docs, _word_counts, "_lang string, word binary, n long")
    words = stored(words.groupBy("_lang", "word").agg(F.sum("n").alias("f")), "words")
    return _named(words, salt)


def _named(words: DataFrame, salt: bytes = b"", named=_salted_id) -> tuple[DataFrame, bytes]:
    while True:
        ids = words.withColumn("id", named(salt))
        other = F.xxhash64(F.lit("other"), "word")
        if ids.groupBy("id").agg(F.min(other).alias("a"), F.max(other).alias("b")).filter("a <> b").isEmpty():
            return ids, salt
        salt += b"."


def _slots(lang: int, first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    h = (first.view(np.uint64) + np.uint64(lang)) * np.uint64(0x9E3779B97F4A7C15) + second.view(np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _pairs(lang: str, texts: list[bytes], salt: bytes, bits: int):
    """``(codes, id of each code, whether each adjacent pair is in one piece, its slot)``."""
    codes, words = _encoded(texts)
    ids = np.array([0, *(word_id(w, salt) for w in words[1:])], np.int64)
    both = (codes[:-1] > 0) & (codes[1:] > 0)
    return codes, ids, both, _slots(xxhash.xxh64_intdigest(lang), ids[codes[:-1]], ids[codes[1:]], bits)


def _cut_by(part: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[list[bytes]]]:
    """``(parts, bytes of each part's columns)`` of rows sorted by part."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), bool), part[1:] != part[:-1])))
    ends = [*first[1:].tolist(), len(part)]
    return part[first], [[c[b:e].tobytes() for b, e in zip(first.tolist(), ends, strict=False)] for c in columns]


def _slot_counts(lang, texts, salt, bits):
    _, _, both, slots = _pairs(lang, texts, salt, bits)
    slots, n = np.unique(slots[both], return_counts=True)
    part, blocks = _cut_by(slots >> PART, [(slots & ((1 << PART) - 1)).astype(np.uint16), n.astype(np.uint32)])
    return part, *blocks


def _bit_table(slots: DataFrame, bits: int, least: int) -> np.ndarray:
    """One bit per slot with at least ``least`` pairs: 2^bits / 8 bytes whatever the input.  A part's counts are summed as they stream in."""
    schema = pa.schema([("part", pa.int64()), ("bits", pa.binary())])

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(1 << PART, np.int64), None
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for at, n in zip(batch.column("slots"), batch.column("counts"), strict=True):
                total[np.frombuffer(at.as_py(), np.uint16)] += np.frombuffer(n.as_py(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], schema=schema)

    width = (1 << PART) // 8
    out = np.zeros(max(1, (1 << bits) >> PART) * width, np.uint8)
    for row in slots.groupBy("part").applyInArrow(often, "part long, bits binary").toLocalIterator():
        out[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return out


def _combined(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of equally long code columns and their counts."""
    key = np.zeros(len(columns[0]), np.int64)
    for c in columns:  # names of prefixes stay below the number of rows, so products are exact
        _, c = np.unique(c, return_inverse=True)
        _, key = np.unique(key * (int(c.max(initial=0)) + 1) + c, return_inverse=True)
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return [c[first] for c in columns], n


def _pointers(lang, texts, salt, bits, groups, shared):
    """Weighted suffix pointers, sorted in blocks of one group: pairs as ``(w1, w2, 0, 0)``, longer suffixes as ``(w1, w2, w3, w4 or 0)``."""
    codes, ids, both, slots = _pairs(lang, texts, salt, bits)
    often = shared.value
    live = both & ((often[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).astype(bool)
    live = np.concatenate((live, np.zeros(LONGEST, bool)))
    code = np.concatenate((codes, np.zeros(LONGEST, np.int32)))
    pair = np.flatnonzero(live)
    long = pair[live[pair + 1]]
    fourth = np.where(live[long + 2], code[long + 3], 0)
    zero = np.zeros(len(pair), np.int32)
    found = [_combined(c) for c in ([code[pair], code[pair + 1], zero, zero], [code[long], code[long + 1], code[long + 2], fourth])]
    w = [ids[np.concatenate(c)] for c in zip(*(columns for columns, _ in found), strict=True)]
    weight = np.concatenate([n for _, n in found])
    group = _slots(xxhash.xxh64_intdigest(lang), w[0] ^ (w[1] * 3), w[2], 63) % groups
    order = np.lexsort((*w[::-1], group))
    group, blocks = _cut_by(group[order], [c[order] for c in (*w, weight)])
    return [word_id(lang.encode())] * len(group), group, *blocks


def frequent_prefixes(columns: list[np.ndarray], weight: np.ndarray, least: int) -> list[tuple[int, ...]]:
    """Multikey three-way quicksort of pointers to strings ``(language, w1, w2, w3, w4)``: ``(*string, count)`` of each prefix of two
    words (those followed by 0), three and four words whose weight is at least ``least``."""
    out = []
    todo = [(np.arange(len(weight)), 0)]
    while todo:
        at, depth = todo.pop()
        key = columns[depth][at]
        pivot = key[len(key) // 2]
        for side in (key < pivot, key > pivot):
            part = at[side]
            if weight[part].sum() >= least:
                todo.append((part, depth))
        same = at[key == pivot]
        count = int(weight[same].sum())
        if count < least:
            continue
        if depth >= 3 and (pivot or depth == 3):
            string = [int(c[same[0]]) for c in columns[: depth + 1]]
            out.append((*string, *[0] * (LONGEST - depth), count))
        if depth < 3 or (depth == 3 and pivot):
            todo.append((same, depth + 1))
    return out


def phrase_counts(docs: DataFrame, salt: bytes, bits: int, least: int) -> DataFrame:
    """``(w0, w1, w2, w3, w4, f)``: language and word ids (0: none) of each phrase of two to four words with ``f >= least``."""
    spark = docs.sparkSession
    slots = _map_languages(docs, lambda lang, texts: _slot_counts(lang, texts, salt, bits), "part long, slots binary, counts binary")
    shared = spark.sparkContext.broadcast(_bit_table(slots, bits, least))
    groups = GROUPS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(["w0 long", "_group long", *(f"{c} binary" for c in _W), "n binary"])
    routed = _map_languages(docs, lambda lang, texts: _pointers(lang, texts, salt, bits, groups, shared), schema)
    names = ["w0", *_W, "f"]
    arrow = pa.schema([(c, pa.int64()) for c in names])

    def sort(part: pa.Table) -> pa.Table:
        blocks = {c: [np.frombuffer(x.as_py(), np.int64) for x in part.column(c)] for c in [*_W, "n"]}
        langs = np.repeat(part.column("w0").to_numpy(), [len(x) for x in blocks["n"]])
        found = frequent_prefixes([langs, *(np.concatenate(blocks[c]) for c in _W)], np.concatenate(blocks["n"]), least)
        return pa.Table.from_pydict(dict(zip(names, zip(*found, strict=True), strict=True)) if found else {c: [] for c in names}, schema=arrow)

    return routed.groupBy("_group").applyInArrow(sort, ", ".join(f"{c} long" for c in names))


def _key(words: list, name: str) -> list:
    padded = [*words, *[F.lit(0).cast("long")] * (LONGEST - len(words))]
    return [w.alias(f"{name}{i + 1}") for i, w in enumerate(padded)]


def _scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``phrases (w0..w4, f)`` with ``l``, ``r`` and ``score`` of the lowest-scoring cut."""
    w = [F.col(c) for c in _W]
    cuts = [F.struct(F.lit(k).alias("k"), *_key(w[:k], "l"), *_key(w[k:], "r")) for k in range(1, LONGEST)]
    cut = phrases.select("w0", *_W, F.col("f").alias("a"), F.explode(F.array(*cuts)).alias("c")).filter("c.r1 <> 0")
    cut = cut.select("w0", *_W, "a", "c.*")
    for side in "lr":
        part = counts.select("w0", *[F.col(c).alias(f"{side}{i + 1}") for i, c in enumerate(_W)], F.col("f").alias(side))
        cut = cut.join(part, ["w0", *[f"{side}{i + 1}" for i in range(LONGEST)]])
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)")
    best = cut.groupBy("w0", *_W).agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("w0", *_W, "a", "b.l", "b.r", "b.score")


def _uncovered(scored: DataFrame, phrases: DataFrame, covered: int) -> DataFrame:
    """Without the phrases most of whose occurrences lie in one longer phrase."""
    w = [F.col(c) for c in _W]
    inside = [(b, m) for m in range(2, LONGEST) for b in range(LONGEST - m + 1)]
    subs = [F.struct((F.lit(b + m)).alias("end"), F.lit(m).alias("m"), *_key(w[b : b + m], "w")) for b, m in inside]
    size = sum(((c != 0).cast("int") for c in w), F.lit(0))
    longer = phrases.withColumn("_n", size).filter("_n > 2").select("w0", "f", "_n", F.explode(F.array(*subs)).alias("s"))
    longer = longer.filter("s.end <= _n AND s.m < _n").groupBy("w0", *[F.col(f"s.{c}").alias(c) for c in _W]).agg(F.max("f").alias("longer"))
    out = scored.join(longer, ["w0", *_W], "left")
    most = F.coalesce("longer", F.lit(0)).cast("decimal(20,0)") * 100
    return out.filter(most < F.col("a").cast("decimal(20,0)") * covered).drop("longer")


def _first_rows(df: DataFrame, by: str, order: list, top: int, number) -> DataFrame:
    """The rows of each group whose ``number`` (rank or row_number) is at most ``top``; a hot group is cut in salted parts first."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*_W), F.lit(SALTS)))
    for keys in ([by, "_salt"], [by]):
        salted = salted.withColumn("rank", number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return salted.drop("_salt")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, covered: int = COVERED, top: int = TOP, bits: int = BITS
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` best phrases of each language."""
    body = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_t"))
    words, salt = _word_table(body)
    phrases = stored(phrase_counts(body, salt, bits, least), "phrases")
    langs = words.groupBy("_lang").agg(F.sum("f").alias("n"))
    lang_ids = F.udf(lambda name: word_id(name.encode()), "long")
    langs = stored(langs.withColumn("w0", lang_ids("_lang")), "languages")
    often = words.filter(F.col("f") >= least).join(langs, "_lang")
    zero = F.lit(0).cast("long")
    one = often.select("w0", F.col("id").alias("w1"), zero.alias("w2"), zero.alias("w3"), zero.alias("w4"), "f")
    scored = _uncovered(_scored(phrases, phrases.unionByName(one)), phrases, covered)
    ranked = stored(_first_rows(scored, "w0", [F.desc("score"), F.desc("a")], top, F.rank).drop("rank"), "ranked-phrases")
    places = ranked.select("w0", *_W, F.posexplode(F.array(*_W)).alias("_at", "id")).filter("id <> 0")
    spelled = words.join(langs, "_lang").select("w0", "id", "word").join(small(stored(places, "phrase-words")), ["w0", "id"])
    spelled = spelled.groupBy("w0", *_W).agg(F.sort_array(F.collect_list(F.struct("_at", "word"))).alias("_words"))  # four at most
    phrase = F.concat_ws(" ", F.transform("_words", lambda x: x["word"].cast("string")))
    named = ranked.join(spelled.select("w0", *_W, phrase.alias("phrase")), ["w0", *_W])
    out = _first_rows(named, "w0", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, F.row_number).join(langs, "w0")
    return out.select(F.col("_lang").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query(
    "op12_phrase_collocations",
    r"""
    WITH d AS (
      SELECT coalesce(lang, 'und') AS lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    ws AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
    places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM ws),
    grams AS (
      SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f
      FROM places, (SELECT unnest([1, 2, 3, 4]) AS k) AS ks WHERE i + k - 1 <= len(w) GROUP BY ALL),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
    often AS (SELECT * FROM grams WHERE f >= 30),
    cand AS (SELECT lang, k AS len, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE k >= 2),
    cuts AS (
      SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS score
      FROM (SELECT *, unnest(range(1, len)) AS k FROM cand) AS c
      JOIN often AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
      JOIN often AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (
      SELECT lang, array_to_string(w[b:b + m - 1], ' ') AS phrase, max(a) AS longer
      FROM cand, (SELECT unnest([1, 2, 3]) AS b) AS bs, (SELECT unnest([2, 3]) AS m) AS ms
      WHERE b + m - 1 <= len AND m < len GROUP BY ALL),
    kept AS (
      SELECT b.* FROM best AS b LEFT JOIN inside AS i ON i.lang = b.lang AND i.phrase = b.phrase
      WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * b.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n.n AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
    """,
)
def op12(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
