"""Texts cut off before their end, by a backward character n-gram model."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from hitloom.runtime import drop_table, materialise

#: Contexts as (view of the text, length in bytes read backward from a position).
CONTEXTS = (("text", 2), ("text", 4), ("text", 8), ("text", 12), ("text", 16), ("shape", 8), ("shape", 12), ("shape", 20))
#: Chains of contexts (places in CONTEXTS) from the least to the most telling; the shape chain starts from the last two bytes as well.
CHAINS = ((0, 1, 2, 3, 4), (0, 5, 6, 7))
#: Bits of the filter of known final contexts per order: 16 a context, within these powers of two.
FILTER_BITS = (18, 26)
#: Characters of a stripped text's tail that hold its final contexts, as a rule; more are taken where they don't.
TAILS = (200, 4_000)
#: Counted contexts held per order before they are summed up, and before the sums are passed on.
PENDING = 300_000
HELD = 1_000_000
#: Bytes of text handled at once.
CHUNK = 256 << 10

_BLANK = " \t\n\r\x00\x0b\x0c\u00a0\u2028\u2029\ufffd"
_BASE = 0x9E3779B97F4A7C15
_MAP = np.arange(256, dtype=np.uint8)
_MAP[ord("1") : ord("9") + 1] = ord("0")
_MAP[[9, 10, 11, 12, 13]] = ord(" ")
_RUN = np.zeros(256, bool)
_RUN[[ord(x) for x in " _-=.*"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0xC3:0xC6] = True  # first bytes of accented Latin letters


def _cut(c: np.ndarray, keep: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return c[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def _views(raw: np.ndarray, starts: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Two normal forms of texts that lie at ``starts`` in ``raw``: bytes and new starts.

    text: digits are 0, any run of white space is one blank, any run of one filler sign one sign. shape: as well, a run of digits is one 0
    and a word with a capital first letter is an X, so that names don't tell contexts apart.
    """
    c = _MAP[raw]
    first = np.zeros(len(c), bool)
    first[starts[:-1][starts[:-1] < len(c)]] = True
    keep = np.ones(len(c), bool)
    keep[1:] = ~(_RUN[c[1:]] & (c[1:] == c[:-1]))
    c, starts_ = _cut(c, keep | first, starts)
    first = np.zeros(len(c), bool)
    first[starts_[:-1][starts_[:-1] < len(c)]] = True

    letter = _LETTER[c]
    letter[1:] |= (c[1:] >= 0x80) & (c[1:] < 0xC0) & (c[:-1] >= 0xC3) & (c[:-1] < 0xC6)
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    begin |= first & letter
    at = np.maximum.accumulate(np.where(begin, np.arange(len(c)), 0))
    name = letter & _UPPER[c[at]] if len(c) else letter
    zero = c == ord("0")
    keep = ~(name & ~begin)
    keep[1:] &= ~(zero[1:] & zero[:-1])
    shape = c.copy()
    shape[name] = ord("X")
    return {"text": (c, starts_), "shape": _cut(shape, keep | first, starts_)}


def _hash(c: np.ndarray, k: int, have: dict[int, np.ndarray]) -> np.ndarray:
    """The hash of the k bytes that end at each position from k - 1 on, from those of shorter pieces."""
    if k not in have:
        if k == 1:
            have[k] = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        else:
            a = 1 << (k - 1).bit_length() - 1
            b = k - a
            n = max(0, len(c) - k + 1)
            have[k] = _hash(c, a, have)[:n] * np.uint64(pow(_BASE, b, 1 << 64)) + _hash(c, b, have)[a : a + n]
    return have[k]


def _hashes(c: np.ndarray, orders: list[int]) -> dict[int, np.ndarray]:
    have: dict[int, np.ndarray] = {}
    return {k: _hash(c, k, have) for k in orders}


def _orders(view: str) -> list[tuple[int, int]]:
    """Contexts of a view, short ones first, as (place in CONTEXTS, length)."""
    return sorted(((i, k) for i, (v, k) in enumerate(CONTEXTS) if v == view), key=lambda x: x[1])


def _chunks(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts of an Arrow array in chunks of about ``CHUNK`` bytes: (first, past last, bytes, starts), without copying."""
    text = text.cast(pa.large_string())
    buf = text.buffers()
    off = np.frombuffer(buf[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(buf[2], np.uint8) if buf[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def stripped(text):
    """A text column without trailing blanks, replacement characters, and an ellipsis that was put after a cut."""
    blank = F.lit(_BLANK)
    bare = F.rtrim(text, blank)
    dots = F.endswith(bare, F.lit("..."))
    sign = F.endswith(bare, F.lit("…")) & ~F.endswith(bare, F.lit("[…"))
    return F.when(dots, F.rtrim(F.left(bare, F.length(bare) - 3), blank)).when(sign, F.rtrim(F.left(bare, F.length(bare) - 1), blank)).otherwise(bare)


def tail(text):
    """The end of a stripped text that fills the longest context of either view.

    ``TAILS`` characters, as a rule the fewer. What counts is how much is left when words, numbers and runs of one sign
    are one character each, which is less than either view leaves; where even the longer tail leaves too little (a text that
    ends in thousands of filler signs), the whole text is taken.
    """
    enough = max(k for _, k in CONTEXTS) + 2
    squeezed = lambda t: F.length(F.regexp_replace(F.regexp_replace(t, r"\p{L}++|\d++", "X"), r"(?s)(.)\1++", "$1"))
    short, long_ = (F.right(text, F.lit(n)) for n in TAILS)
    return F.when(F.length(text) <= TAILS[0], text).when(squeezed(short) >= enough, short).when(squeezed(long_) >= enough, long_).otherwise(text)


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tail) -> (id, th, h0, h1, ...): a hash of the tail, and those of its final contexts, null where the tail is shorter."""
    for b in batches:
        if not b.num_rows:
            continue
        tails = b.column(1).to_pylist()
        th = np.array([int.from_bytes(blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for t in tails], np.int64)
        out: list[list] = [[] for _ in CONTEXTS]
        for _, _, raw, starts in _chunks(pa.array(tails, pa.large_string())):
            for view, (c, at) in _views(raw, starts).items():
                hs = _hashes(c, [k for _, k in _orders(view)])
                for i, k in _orders(view):
                    have = np.diff(at) >= k
                    h = np.zeros(len(have), np.int64)
                    h[have] = hs[k][at[1:][have] - k].view(np.int64)
                    out[i].append(pa.array(h, mask=~have))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(th), *(pa.concat_arrays(o) for o in out)], names=["id", "th", *(f"h{i}" for i in range(len(CONTEXTS)))])


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _count_inner(filters: dict[int, tuple[int, bytes]]):
    """Counts, over whole texts, of the contexts that may be final ones and are followed by more text.

    A task holds at most about ``HELD`` sums per order and passes them on beyond that; what is passed on twice is added up later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {k: (bits, np.frombuffer(f, np.uint8)) for k, (bits, f) in filters.items()}
        sums: dict[int, list] = {i: [] for i in range(len(CONTEXTS))}
        pending = [0] * len(CONTEXTS)
        total = 0

        def squeeze(i: int) -> None:
            keys = np.concatenate([a for a, _ in sums[i]])
            n = np.concatenate([b for _, b in sums[i]])
            u, inv = np.unique(keys, return_inverse=True)
            sums[i] = [(u, np.bincount(inv, n, len(u)).astype(np.int64))]
            pending[i] = 0

        def passed_on(o: int) -> Iterator[pa.RecordBatch]:
            squeeze(o)
            u, n = sums[o][0]
            sums[o] = []
            for s in range(0, len(u), 50_000):
                m = len(u[s : s + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, o, np.int32)), pa.array(u[s : s + 50_000].view(np.int64)), pa.array(n[s : s + 50_000])], names=["k", "h", "m"])

        def known(o: int, x: np.ndarray) -> np.ndarray:
            bits, f = seen[o]
            at = _slot(x, bits)
            return (f[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

        for b in batches:
            for _, _, raw, begins in _chunks(b.column(0)):
                views = _views(raw, begins)
                for view, (c, starts) in views.items():
                    lens = np.diff(starts)
                    at = np.arange(len(c)) - np.repeat(starts[:-1], lens)  # place within the text
                    pos = np.flatnonzero(at < np.repeat(lens, lens) - 1)
                    total += len(pos) * (view == "text")
                    hs = _hashes(c, [k for _, k in _orders(view)])
                    for o, k in _orders(view):
                        pos = pos[at[pos] >= k - 1]
                        x = hs[k][pos - (k - 1)]
                        if k > 4:  # a longer context can only be a final one where the shorter is
                            hit = known(o, x)
                            pos, x = pos[hit], x[hit]
                        sums[o].append(np.unique(x, return_counts=True))
                        pending[o] += len(sums[o][-1][0])
                        if pending[o] > max(PENDING, len(sums[o][0][0])):
                            squeeze(o)
                            if len(sums[o][0][0]) > HELD:
                                yield from passed_on(o)
        for o in range(len(CONTEXTS)):
            if sums[o]:
                yield from passed_on(o)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], names=["k", "h", "m"])

    return run


def _filters(ends: DataFrame) -> dict[int, tuple[int, bytes]]:
    """Per order a bitmap of the final contexts, as (bits of a slot's number, bitmap).

    Its size follows their number, 16 bits a context, from 32 KB up to 8 MB. It only spares work: a context
    that isn't a final one but falls on a set bit is counted and then left out by the exact join.
    """
    number = {r["k"]: r["n"] for r in ends.groupBy("k").agg(F.count("*").alias("n")).collect()}
    bits = {k: min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * number.get(k, 0)).bit_length())) for k in range(len(CONTEXTS))}
    slot = F.coalesce(*[F.when(F.col("k") == k, F.shiftrightunsigned("h", 64 - b)) for k, b in bits.items()])
    rows = ends.withColumn("s", slot).groupBy("k", F.shiftright("s", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("s") % 32768).alias("bits"))
    whole = {k: bytearray((1 << b) // 8) for k, b in bits.items()}
    for r in rows.toLocalIterator():  # at most 2**26 / 32768 rows of 4 KB per order
        whole[r["k"]][r["b"] * 4096 : (r["b"] + 1) * 4096] = r["bits"]
    return {k: (bits[k], bytes(v)) for k, v in whole.items()}


def final_log_odds(df: DataFrame, doc: str = "doc_id", text: str = "text", weight: float = 4.0) -> DataFrame:
    """``doc, log_odds``: evidence that a text may end where it does, against that it goes on.

    The model reads backward from a position: contexts are the last bytes of two normal
    forms of the text (``CONTEXTS``). For each context it knows how many different texts end with it and how
    often, over the whole corpus, it is followed by more text. The chance of an end is interpolated from short to long
    contexts, each with the evidence of ``weight`` of its shorter one; the text's own end is left out. Of the two
    views the one that rather lets the text end counts. ``log_odds`` is against the chance of an end at any place.

    Trailing blanks, replacement characters and an ellipsis put after a cut aren't part of the context. Texts
    with equal tails count as one end, so that copies of a cut text don't vouch for each other.
    Null and empty texts have no row; a text shorter than a context is judged by the shorter ones.
    """
    texts = df.select(F.col(doc).alias("id"), F.col(text).alias("t")).where("t is not null and t <> ''")
    tails = texts.select("id", stripped(F.col("t")).alias("t")).select("id", tail(F.col("t")).alias("tail"))
    schema = "id long, th long, " + ", ".join(f"h{k} long" for k in range(len(CONTEXTS)))
    finals = materialise(tails.mapInArrow(_final, schema).where("h0 is not null"), "finals")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h")) for k in range(len(CONTEXTS))])).alias("c")
    pairs = finals.select("id", "th", each).select("id", "th", "c.k", "c.h").where("h is not null")
    ends = materialise(pairs.groupBy("k", "h", "th").agg(F.count("*").alias("d")).groupBy("k", "h").agg(F.count("*").alias("n"), F.sum("d").alias("d")), "ends")
    none = F.lit(0).cast("long")
    inner = texts.select("t").mapInArrow(_count_inner(_filters(ends)), "k int, h long, m long")
    counted = ends.select("k", "h", "n", "d", none.alias("m")).unionByName(inner.select("k", "h", none.alias("n"), none.alias("d"), "m"))
    known = materialise(counted.groupBy("k", "h").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("m").alias("m")).where("n > 0 or k = -1"), "known")
    drop_table(ends)
    base = known.where("k = -1").select("m").first()
    chars = max(1, base["m"] if base else 1)
    size = finals.agg(F.count_distinct("th").alias("ends"), F.count("*").alias("docs")).first()
    n_ends = max(1, size["ends"])
    prior = n_ends / (n_ends + chars)

    # Contexts that end at least one text in a thousand: at most a thousand of them per order, so they may be broadcast.
    # All others are joined by shuffling, where no key has more than a thousandth of the texts.
    often = F.col("d") * 1_000 >= F.lit(size["docs"])
    contexts = known.where("k >= 0").select("k", "h", "n", "m", often.alias("often"))
    hot = contexts.where("often").select("k", "h", F.struct("n", "m").alias("c"))
    seen = pairs.select("id", "k", "h").join(F.broadcast(hot), ["k", "h"], "left")
    rare = seen.where("c is null").drop("c").join(contexts.where("not often").select("k", "h", F.struct("n", "m").alias("c")), ["k", "h"])
    by_text = seen.where("c is not null").unionByName(rare).groupBy("id").agg(*[F.max(F.when(F.col("k") == k, F.col(f"c.{x}"))).alias(f"{x}{k}") for k in range(len(CONTEXTS)) for x in "nm"])
    chances = []
    for chain in CHAINS:
        p = F.lit(prior)
        for k in chain:
            n, m = F.coalesce(F.col(f"n{k}") - 1, F.lit(0)), F.coalesce(f"m{k}", F.lit(0))
            p = (n + weight * p) / (n + m + weight)
        chances.append(p)
    p = F.greatest(*chances)
    odds = F.log(p / (1 - p)) - F.log(F.lit(prior / (1 - prior)))
    return by_text.select(F.col("id").alias(doc), odds.alias("log_odds"))


#: Spellings of the languages in the data.
LANGUAGES = {"en": "en", "eng": "en", "de": "de", "ger": "de", "deu": "de", "fr": "fr", "fra": "fr", "fre": "fr"}


def thresholds(odds: DataFrame, lowest: float = 1.5, highest: float = 4.5, pull: float = 200.0) -> DataFrame:
    """``language, threshold``: the emptiest place between cut and complete texts.

    Log-odds of a language are counted in quarters; of the runs of five quarters centred between ``lowest``
    and ``highest`` the one with fewest texts is taken, the middle one of equals. The shares of all texts count in every
    language with the weight of ``pull`` texts, so that a language of few texts follows the whole and one of many itself.
    """
    centres = [lowest + 0.25 * i for i in range(int((highest - lowest) / 0.25) + 1)]
    near = [F.count_if(F.abs(F.col("log_odds") - c) <= 0.625) for c in centres]
    counts = odds.groupBy("language").agg(F.count("*").alias("n"), *[x.alias(f"c{i}") for i, x in enumerate(near)])
    w = Window.partitionBy(F.lit("all"))  # a row per language
    shares = [F.round(F.col(f"c{i}") + pull * F.sum(f"c{i}").over(w) / F.sum("n").over(w), 6) for i in range(len(centres))]
    near_ = counts.select("language", F.array(*shares).alias("near"))
    at = F.filter(F.sequence(F.lit(0), F.lit(len(centres) - 1)), lambda i: F.get("near", i) == F.array_min("near"))
    middle = F.get(at, F.floor((F.size(at) - 1) / 2).cast("int"))
    return near_.select("language", (F.lit(lowest) + middle * 0.25).alias("threshold"))


def field_limits(judged: DataFrame) -> DataFrame:
    """``source, unit, size, n, k``: lengths of which a source has cut texts, with all its texts and the cut ones there.

    ``judged(source, chars, bytes, cut)`` by the model alone; a length is counted in characters and in bytes.
    """
    sizes = judged.select("source", "cut", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("s"))
    return sizes.groupBy("source", "s.unit", "s.size").agg(F.count("*").alias("n"), F.count_if("cut").alias("k")).where("k > 0")


def limit_shift(n, k, cut, rate: float, pull: float = 5.0, most_shift: float = 5.0):
    """By how much the share of cut texts among the *other* ones of its source and length raises a text's threshold.

    The log of the odds of a cut there, the rate of all texts counting as ``pull`` texts, over those of all texts; 0 to ``most_shift``.
    A length that no other text of the source has tells nothing, and the shift grows with the texts that have it.
    """
    own = F.when(cut, 1).otherwise(0)
    k, n = k - own, n - 1
    odds = F.log((k + pull * rate) / (n - k + pull * (1 - rate))) - float(np.log(rate / (1 - rate)))
    return F.when(odds.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(most_shift), odds)))


def truncated(df: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``doc, source, language, log_odds, threshold, cut`` for every text that isn't null or empty.

    A text is cut where its ``log_odds`` (:func:`final_log_odds`) lie below its language's threshold, which is higher at
    lengths at which other texts of its source are cut (:func:`limit_shift`).
    Languages are brought to one spelling; null and unknown ones share a threshold. A text of
    nothing but blanks and an ellipsis has no context and isn't called cut.
    """
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    texts = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(
        F.col(doc).alias("_d"), F.col(source).alias("source"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), F.coalesce(F.try_element_at(names, F.lower(F.trim(F.col(lang)))), F.lit("other")).alias("language")
    )
    odds = final_log_odds(df.select(F.col(doc).alias("_d"), F.col(text).alias("_t")), "_d", "_t")
    judged = materialise(texts.join(odds, "_d", "left"), "judged")
    first = judged.join(thresholds(judged), "language").withColumn("cut", F.coalesce(F.col("log_odds") < F.col("threshold"), F.lit(False)))
    overall = first.agg(F.count("*").alias("n"), F.count_if("cut").alias("k")).first()  # one row
    rate = (overall["k"] + 0.5) / (overall["n"] + 1)
    limits = materialise(field_limits(first), "limits")
    out = first
    for unit in ("chars", "bytes"):
        own = limits.where(F.col("unit") == unit).select(F.col("source").alias("_s"), F.col("size").alias("_n"), F.col("n").alias("_all"), F.col("k").alias("_cut"))
        out = out.join(own, F.col("source").eqNullSafe(F.col("_s")) & (F.col(unit) == F.col("_n")), "left").withColumn(f"_{unit}", F.coalesce(limit_shift(F.col("_all"), F.col("_cut"), F.col("cut"), rate), F.lit(0.0))).drop("_s", "_n", "_all", "_cut")
    raised = F.col("threshold") + F.greatest("_chars", "_bytes")
    return out.select(F.col("_d").alias(doc), F.col("source").alias(source), "language", "log_odds", raised.alias("threshold"), F.coalesce(F.col("log_odds") < raised, F.lit(False)).alias("cut"))
