"""Scoring by a hierarchical Pitman-Yor language model.

Restaurants. The root holds the words of the corpus over a uniform base. Below it
stands one restaurant for each word that something follows, and one for the start
of texts; all share the root as their parent. A token is a customer of the
restaurant of the word before it, and each table there is a customer at the root.
So the restaurants and their dishes grow with the corpus.

Seating. The customers of one dish in one restaurant are a block: given the
parent's share of the dish and the restaurant's totals, the number t of their
tables follows S_d(c, t) a^t (generalised Stirling numbers), and a Gibbs step
draws it anew; then the root seats the dish's new customers in the same way.
Blocks beyond `EXACT` customers follow the same law: the generating function of its
weights moves from `EXACT` to c customers by a thinned weight and a Poisson number
of further tables. A sweep draws all blocks given the seating before it, and then
sums up the totals of restaurants; at first, each block has one table. Predictive
probabilities are averages over the `SWEEPS - BURN` sweeps after the first `BURN`.
The discounts come from the counts of counts, the concentrations are `THETA`.

At scale. A block is one row, and so are a word and a context: a sweep joins blocks
with the totals of their context and the share of their word, which are sums with
map-side combine. No restaurant is ever gathered in one place, and skewed joins
split. Blocks of one customer always have one table, so sweeps leave them out and
count them once. Every sweep is written, and a draw is keyed by its block, so a
task that runs again draws the same. The driver sees sums over all rows only.
Most pairs occur once, and nearly as many as there are tokens. A pair of two of the
`HOT` words that are broadcast with their totals needs no row for that: without a
row it has one customer if its text is of the training set and none if it is held
out, and the totals of words and contexts follow from the counts of words and the
pairs that occur twice. So one pass over the texts counts, with such pairs as one
number, and rows are written of pairs that occur again or have another word.
To score, texts are read once more: tokens of two broadcast words are scored as if
their pair had no row, and what a row changes is added. That of pairs with a
share of at least 1 / `HOT` of all (so at most `HOT`, which are broadcast, too) is
added on the spot, that of others by a join, as are the scores of all other tokens.
A Bloom filter of fixed size spares the join tokens whose pair has no row. A sample
names the words to broadcast; any choice of them gives the same scores.
Words and pairs are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.collocations import filter_bits, passes
from tidepanel.llm.common import discard, release, written

HOT = 500_000
#: One text in so many is asked which words to broadcast.
SAMPLE = 16
#: What a row of `tallies` counts: a pair of two broadcast words, another pair, a word.
BOTH, PAIR, WORD = range(3)
EXACT = 1024
CELLS = 4_000_000
SWEEPS, BURN = 3, 1
THETA = 1.0
SEED = 42
REMEMBERED = 400_000
CHUNK = 2_000_000


class Hashes(dict):
    """Words met so far, with their hashes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


END = np.uint64(xxhash.xxh64_intdigest(b" ", SEED))  # no word holds a blank
_HASHES = Hashes()


def tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Token hashes, those before them and lengths of texts, some texts at a time: (first text, w, ctx, tokens of each text).

    Words are cut at the blank and U+0009 to U+000D, and A-Z is lower-case; the
    end of every text is a token, and what stands before its first. Null is empty.
    """
    flat: list[int] = []
    sizes: list[int] = []
    first = 0
    for text in texts.cast(pa.binary()):
        words = (text.as_py() or b"").lower().split()
        flat.extend(map(_HASHES.__getitem__, words))
        flat.append(int(END))
        sizes.append(len(words) + 1)
        if len(flat) >= CHUNK:
            yield first, *_arrays(flat, sizes)
            first, flat, sizes = first + len(sizes), [], []
    if sizes:
        yield first, *_arrays(flat, sizes)


def _arrays(flat: list[int], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = np.array(flat, np.uint64)
    return w, np.concatenate(([END], w[:-1])), np.array(sizes)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits each of which depends on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(w: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Hashes of pairs of a word and the one before it."""
    return mixed(w + np.uint64(0x9E3779B97F4A7C15) * mixed(ctx))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def pairs(docs: DataFrame) -> DataFrame:
    """(k, w, ctx, n, m): every word of (doc_id, text) after every other, with its counts in the training texts and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            training = batch["training"].to_numpy(zero_copy_only=False)
            for first, w, ctx, sizes in tokens(batch["text"]):
                k, at, place = np.unique(pair_keys(w, ctx), return_index=True, return_inverse=True)
                n = np.bincount(place, weights=np.repeat(training[first:first + len(sizes)], sizes), minlength=len(k))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in (k, w[at], ctx[at])), pa.array(n.astype(np.int64)), pa.array(np.bincount(place))],
                    ["k", "w", "ctx", "n", "m"])

    counted = docs.select((~held_out(F.col("doc_id"))).alias("training"), "text").mapInArrow(run, "k long, w long, ctx long, n long, m long")
    return counted.groupBy("k").agg(F.max("w").alias("w"), F.max("ctx").alias("ctx"), F.sum("n").alias("n"), F.sum("m").alias("m"))


def places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def frequent_words(texts: DataFrame) -> DataFrame:
    """(w) of at most `HOT` words, those that a sample of (id, text) has most often; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, w, _, _ in tokens(batch["text"]):
                u, n = np.unique(w.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["w", "n"])

    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "w long, n long")
    return written(some.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(HOT).select("w"), "frequent")[0]


_TALLY = "kind byte, w long, ctx long, n long, m long"


def tallies(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """(kind, w, ctx, n, m): all words of (doc_id, text), and all pairs but those of two words of `hot` (sorted) that have no row.

    n and m as in `pairs`. Without a row, n is 1 for a pair of a training text and 0 for one that only held-out texts have.
    """
    sent = texts.sparkSession.sparkContext.broadcast(hot)

    def rows(kind: int, w: np.ndarray, ctx: np.ndarray | None, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(w), kind, np.int8)), pa.array(w), pa.nulls(len(w), pa.int64()) if ctx is None else pa.array(ctx),
            pa.array(n.astype(np.int64)), pa.array(m)], ["kind", "w", "ctx", "n", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            training = batch["training"].to_numpy(zero_copy_only=False)
            for first, w, _, sizes in tokens(batch["text"]):
                mine = np.repeat(training[first:first + len(sizes)], sizes)
                u, at = np.unique(w.view(np.int64), return_inverse=True)
                yield rows(WORD, u, None, np.bincount(at, weights=mine), np.bincount(at))
                before = np.concatenate(([np.searchsorted(u, END.view(np.int64))], at[:-1]))
                codes, back = np.unique(at * len(u) + before, return_inverse=True)
                n, m = np.bincount(back, weights=mine), np.bincount(back)
                a, b = codes // len(u), codes % len(u)
                place, here = places(sent.value, u)
                both = here[a] & here[b]
                yield rows(BOTH, place[a[both]] << 32 | place[b[both]], None, n[both], m[both])
                yield rows(PAIR, u[a[~both]], u[b[~both]], n[~both], m[~both])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.filter(pa.array(batch["kind"].to_numpy() == BOTH))
            code = both["w"].to_numpy()
            yield rows(BOTH, sent.value[code >> 32], sent.value[code & 0xFFFFFFFF], both["n"].to_numpy(), both["m"].to_numpy())
            yield batch.filter(pa.array(batch["kind"].to_numpy() != BOTH))

    counted = texts.select((~held_out(F.col("doc_id"))).alias("training"), "text").mapInArrow(run, _TALLY)
    whole = counted.groupBy("kind", "w", "ctx").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return whole.where((F.col("kind") != BOTH) | (F.col("n") > 1) | ((F.col("n") == 1) & (F.col("m") > 1))).mapInArrow(named, _TALLY)


class Keyed:
    """Draws that depend on a row's key and the sweep only, not on the rows around it."""

    def __init__(self, keys: np.ndarray, turn: int):
        self.keys, self.turn = keys.view(np.uint64), turn

    def of(self, rows: np.ndarray) -> Keyed:
        return Keyed(self.keys[rows], self.turn)

    def random(self, size: int) -> np.ndarray:
        return (mixed(self.keys + mixed(np.full(size, 2 * self.turn + 1, np.uint64))) >> np.uint64(11)) / 2.0**53

    def poisson(self, mean: np.ndarray) -> np.ndarray:
        return np.array([np.random.default_rng([self.turn, int(k)]).poisson(m) for k, m in zip(self.keys, mean, strict=True)], np.int64)


def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S_d(c, t) of the generalised Stirling numbers, -inf where there is none."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[1, 1] = 0.0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, most):
            stay = table[c, 1:] + np.log(np.where(t <= c, c - d * t, 1.0))
            table[c + 1, 1:] = np.logaddexp(table[c, :-1], stay)
    return table


class Seats:
    """Draws numbers of tables for blocks of customers in restaurants of discount `d`."""

    def __init__(self, d: float):
        self.d, self.table = d, stirling(d)

    def draw(self, c: np.ndarray, a: np.ndarray, rng: np.random.Generator | Keyed) -> np.ndarray:
        """Tables of blocks of c >= 1 customers, where a new table has weight `a`."""
        tables = np.ones(len(c), np.int64)
        many = np.flatnonzero(c > EXACT)
        # Between EXACT and c customers the weights a^t S_d(c, t) / Gamma(c) flow as those of a pure birth chain,
        # which thins the weight and adds a Poisson number of tables. Half a step and half the discounts shift c.
        weight, tops = a.astype(float), np.ones(len(many))
        for last in (False, True):
            shift = np.minimum((1 + self.d * tops) / 2, EXACT / 2)
            thin = ((EXACT - shift) / (c[many] - shift)) ** self.d
            weight[many], more = a[many] * thin, a[many] * (1 - thin) / self.d
            if not last:
                tops = self._sized(np.full(len(many), EXACT), weight[many], None) + more
        tables = self._sized(np.minimum(c, EXACT), weight, rng.random(len(c))).astype(np.int64)
        tables[many] += (rng.of(many) if isinstance(rng, Keyed) else rng).poisson(more)
        return np.minimum(tables, c)

    def _sized(self, c: np.ndarray, a: np.ndarray, drawn: np.ndarray | None) -> np.ndarray:
        """Tables of blocks of at most EXACT customers by numbers drawn from 0 to 1, or their means without these."""
        tables = np.ones(len(c))
        order = np.argsort(c, kind="stable")
        edges = np.searchsorted(c[order], np.arange(2, EXACT + 2))
        for size in np.flatnonzero(np.diff(edges)) + 2:
            low, high = edges[size - 2], edges[size - 1]
            t = np.arange(1, size + 1)
            for start in range(low, high, CELLS // size):
                rows = order[start:min(start + CELLS // size, high)]
                weight = self.table[size, 1:size + 1] + t * np.log(a[rows])[:, None]
                share = np.exp(weight - weight.max(axis=1, keepdims=True))
                if drawn is None:
                    tables[rows] = share @ t / share.sum(axis=1)
                    continue
                share = np.cumsum(share, axis=1)
                tables[rows] = 1 + (share < drawn[rows][:, None] * share[:, -1:]).sum(axis=1)
        return tables


class Root:
    """Totals of the root after a sweep: `guests` customers at `tops` tables, of `words` different words."""

    def __init__(self, guests: int, tops: int, words: int, d: float):
        self.guests, self.words, self.d = guests, words, d
        #: Weight of a word's first table.
        self.fresh = (THETA + d * tops) / (words + 1)

    def share(self, guests: Column, tops: Column) -> Column:
        """The predictive share of a word with `guests` customers at `tops` tables."""
        return (guests - self.d * tops + self.fresh) / (self.guests + THETA)


def _discount(one: int | None, two: int | None) -> float:
    return min(max(one / (one + 2 * (two or 0)), 0.05), 0.95) if one else 0.5


class Model:
    """A fitted model: written tables of `blocks`, `contexts` and `words`, and the root after every kept sweep.

    blocks (k, w, ctx, m, kind, lead): customers beyond the discounts, averaged over the kept sweeps.
    contexts (ctx, customers, tables_0, ...), words (w, c, guests_0, tops_0, ...): after every kept sweep.
    """

    def __init__(self, blocks: DataFrame, contexts: DataFrame, words: DataFrame, roots: list[Root], d: float, tokens: int, paths: list[str]):
        self.blocks, self.contexts, self.words, self.roots, self.d, self.tokens, self.paths = blocks, contexts, words, roots, d, tokens, paths

    def _shares(self) -> DataFrame:
        none = F.lit(0)
        shares = [root.share(F.coalesce(f"guests_{i}", none), F.coalesce(f"tops_{i}", none)).alias(f"share_{i}") for i, root in enumerate(self.roots)]
        return self.words.select("w", (F.col("c") > 0).alias("known"), *shares, F.log10(
            (F.col("c") + 0.1) / (self.tokens + 0.1 * (self.roots[0].words + 1))).alias("base"))

    def _backs(self) -> tuple[Column, list[Column]]:
        none = F.lit(0)
        all_ = F.coalesce("customers", none) + THETA
        return all_, [((THETA + self.d * F.coalesce(f"tables_{i}", none)) / all_).alias(f"back_{i}") for i in range(len(self.roots))]

    def scored(self, blocks: DataFrame | None = None) -> DataFrame:
        """(k, m, score, base, known) of every pair, or of those of `blocks`: log10 of its probability in the model and in the base, and whether the word is known."""
        all_, backs = self._backs()
        led = (self.blocks if blocks is None else blocks).join(self.contexts, "ctx", "left").select("k", "w", "m", (F.col("lead") / all_).alias("lead"), *backs)
        rest = sum((F.col(f"back_{i}") * F.col(f"share_{i}") for i in range(len(self.roots))), F.lit(0.0)) / len(self.roots)
        return led.join(self._shares(), "w").select("k", "m", F.log10(F.col("lead") + rest).alias("score"), "base", "known")

    def vocabulary(self, hot: DataFrame) -> Vocabulary:
        """What the words of (w) make of a pair, to be broadcast."""
        all_, backs = self._backs()
        known = self._shares().join(hot, "w").join(self.contexts.withColumnRenamed("ctx", "w"), "w", "left")
        turns = range(len(self.roots))
        return Vocabulary(known.select("w", "known", "base", *(f"share_{i}" for i in turns), all_.alias("all"), *backs).toArrow(), len(self.roots))


def fit(counts: DataFrame, turns: int = SWEEPS, burn: int = BURN) -> Model:
    """The model of written `pairs`, after `turns` sweeps of which the first `burn` are not kept."""
    return fitted(counts.select(F.lit(PAIR).cast("byte").alias("kind"), "w", "ctx", "n", "m"), counts.groupBy("w").agg(F.sum("n").alias("c")), turns, burn)


def fitted(blocks: DataFrame, totals: DataFrame, turns: int = SWEEPS, burn: int = BURN) -> Model:
    """The model of (kind, w, ctx, n, m), with all pairs of two customers or more, and of the counts (w, c) of all words."""
    spark, none = blocks.sparkSession, F.lit(0)
    seats = blocks.where("n > 1")
    again = (F.sum("n").alias("again"), F.count("*").alias("many"))
    sums = seats.agg(*again, F.count_if(F.col("n") == 2).alias("two")).first()
    all_tokens = totals.agg(F.sum("c").alias("n")).first().n or 0
    # Every token has a next one but the last, which stands before the first: a word's customers are its count.
    # `fixed`: tables of the blocks with one customer, which no sweep changes.
    one = F.col("c") - F.coalesce("again", none)
    contexts, contexts_path = written(totals.where("c > 0").withColumnRenamed("w", "ctx").join(seats.groupBy("ctx").agg(*again), "ctx", "left").select(
        "ctx", F.col("c").alias("customers"), one.alias("fixed"), (one + F.coalesce("many", none)).alias("tables")), "contexts")
    guests = one + F.coalesce("many", none)
    words, words_path = written(totals.join(seats.groupBy("w").agg(*again), "w", "left").select(
        "w", "c", one.alias("fixed"), guests.alias("guests"), F.least(guests, F.lit(1)).alias("tops")), "words")
    release(spark)
    single = all_tokens - (sums.again or 0)
    named = words.agg(F.count_if(F.col("guests") > 0).alias("v"), F.count_if(F.col("guests") == 1).alias("one"),
                      F.count_if(F.col("guests") == 2).alias("two")).first()
    d, d_root = _discount(single, sums.two), _discount(named.one, named.two)
    root = Root(single + sums.many, named.v, named.v, d_root)
    seats = seats.withColumns({"t": F.lit(1).cast("long"), "kept": F.lit(0).cast("long")})
    seats_path, roots = None, []

    for turn in range(turns):
        keep = turn >= burn

        def seated(batches: Iterator[pa.RecordBatch], turn: int = turn, keep: bool = keep) -> Iterator[pa.RecordBatch]:
            law = Seats(d)
            for batch in batches:
                k = pair_keys(*(batch[c].to_numpy().view(np.uint64) for c in ("w", "ctx")))
                t = law.draw(batch["n"].to_numpy(), batch["a"].to_numpy(), Keyed(k, turn))
                kept = batch["kept"].to_numpy() + keep * t
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("kind", "w", "ctx", "n", "m")), pa.array(t), pa.array(kept)],
                                                 ["kind", "w", "ctx", "n", "m", "t", "kept"])

        def topped(batches: Iterator[pa.RecordBatch], turn: int = turn, fresh: float = root.fresh) -> Iterator[pa.RecordBatch]:
            law = Seats(d_root)
            for batch in batches:
                guests = batch["guests"].to_numpy()
                tops = law.draw(np.maximum(guests, 1), np.full(len(guests), fresh), Keyed(batch["w"].to_numpy(), -1 - turn & 0xFFFF))
                at = batch.schema.get_field_index("tops")
                yield batch.set_column(at, "tops", pa.array(np.minimum(tops, guests)))

        room = contexts.select("ctx", (THETA + d * F.col("tables")).alias("room"))
        shares = words.select("w", root.share(F.col("guests"), F.col("tops")).alias("share"))
        drawn = seats.join(room, "ctx").join(shares, "w").withColumn("a", F.col("room") * F.col("share")).drop("room", "share", "t")
        old = [p for p in (seats_path, contexts_path, words_path) if p]
        seats, seats_path = written(drawn.mapInArrow(seated, f"{_TALLY}, t long, kept long"), "seats")
        release(spark)
        place = len(roots)
        by_context = seats.groupBy("ctx").agg(F.sum("t").alias("t"))
        tables = (F.col("fixed") + F.coalesce("t", F.lit(0))).alias("tables")
        contexts, contexts_path = written(contexts.drop("tables").join(by_context, "ctx", "left").select(
            *contexts.drop("tables").columns, tables, *([tables.alias(f"tables_{place}")] if keep else [])), "contexts")
        by_word = seats.groupBy("w").agg(F.sum("t").alias("t"))
        guests = (F.col("fixed") + F.coalesce("t", F.lit(0))).alias("guests")
        seen = words.drop("guests", "tops")
        sized = seen.join(by_word, "w", "left").select(*seen.columns, guests, F.lit(0).cast("long").alias("tops"))
        named_now = sized.mapInArrow(topped, sized.schema)
        if keep:
            named_now = named_now.withColumns({f"guests_{place}": F.col("guests"), f"tops_{place}": F.col("tops")})
        words, words_path = written(named_now, "words")
        total = words.agg(F.sum("guests").alias("guests"), F.sum("tops").alias("tops")).first()
        root = Root(total.guests or 0, total.tops or 0, named.v, d_root)
        roots += [root] * keep
        for path in old:
            discard(spark, path)
        release(spark)

    lead = F.col("n") - F.when(F.col("n") > 0, d).otherwise(0.0)
    few = blocks.where("n < 2").select("w", "ctx", "m", "kind", lead.alias("lead"))
    many = seats.select("w", "ctx", "m", "kind", (F.col("n") - d * F.col("kept") / len(roots)).alias("lead"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = pair_keys(*(batch[c].to_numpy().view(np.uint64) for c in ("w", "ctx")))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), *batch.columns], ["k", *batch.schema.names])

    return Model(few.union(many).mapInArrow(keyed, "k long, w long, ctx long, m long, kind byte, lead double"), contexts, words, roots, d, all_tokens,
                 [p for p in (seats_path, contexts_path, words_path) if p])


class Vocabulary:
    """The broadcast words: what each adds to the probability of a pair, as its word and as its context."""

    def __init__(self, rows: pa.Table, turns: int):
        order = np.argsort(rows["w"].to_numpy())
        column = lambda c: rows[c].to_numpy()[order]
        self.w, self.known, self.base, self.all = map(column, ("w", "known", "base", "all"))
        self.share, self.back = ([column(f"{c}_{i}") for i in range(turns)] for c in ("share", "back"))

    def score(self, w: np.ndarray, ctx: np.ndarray, lead: np.ndarray | float) -> np.ndarray:
        """log10 of the probabilities of pairs by the places of their words, with so many customers beyond the discounts."""
        rest = sum(share[w] * back[ctx] for share, back in zip(self.share, self.back, strict=True)) / len(self.share)
        return np.log10(lead / self.all[ctx] + rest)


def corrections(blocks: DataFrame, law: Broadcast, d: float) -> DataFrame:
    """(k, m, seen, unseen) of pairs of two broadcast words: their score beyond that of one customer, and beyond that of none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, ctx = (places(law.value.w, batch[c].to_numpy())[0] for c in ("w", "ctx"))
            score = law.value.score(w, ctx, batch["lead"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch["k"], batch["m"], *(pa.array(score - law.value.score(w, ctx, lead)) for lead in (1 - d, 0.0))], ["k", "m", "seen", "unseen"])

    return blocks.mapInArrow(each, "k long, m long, seen double, unseen double")


class Frequent:
    """What the most frequent pairs add, looked up on the spot."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows["k"].to_numpy())
        self.k, self.seen, self.unseen, self.base, self.known = (rows[c].to_numpy()[order] for c in ("k", "seen", "unseen", "base", "known"))


_OF = "struct<doc_id: long, score: double, base: double, n_tokens: long, n_known: long>"


def _routed(rows: DataFrame, law: Broadcast, frequent: Broadcast, bits: Broadcast, d: float) -> DataFrame:
    """A row for every token that a pair's row may add to, and one per document with its size and the sums of what is known on the spot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs_ = law.value, frequent.value
        for batch in batches:
            ids, names = batch["id"].to_numpy(), batch["doc_id"]
            training = batch["training"].to_numpy(zero_copy_only=False)
            for first, w, ctx, sizes in tokens(batch["text"]):
                count = len(sizes)
                doc, mine = np.repeat(np.arange(count), sizes), np.repeat(training[first:first + count], sizes)
                u, at = np.unique(w.view(np.int64), return_inverse=True)
                place, here = (x[at] for x in places(words.w, u))
                end, ended = places(words.w, np.array([END.view(np.int64)]))
                before, both = np.concatenate((end, place[:-1])), here & np.concatenate((ended, here[:-1]))
                score, base, known = np.zeros(len(w)), np.zeros(len(w)), np.zeros(len(w), np.int64)
                score[both] = words.score(place[both], before[both], np.where(mine[both], 1 - d, 0.0))
                base[both], known[both] = words.base[place[both]], words.known[place[both]]
                k = pair_keys(w, ctx).view(np.int64)
                at, often = places(pairs_.k, k)
                at = at[often]
                score[often] += np.where(mine[often], pairs_.seen[at], pairs_.unseen[at])
                base[often] += pairs_.base[at]
                known[often] += pairs_.known[at]
                asked = ~often
                maybe = np.flatnonzero(asked & both)
                asked[maybe] = passes(bits.value, k[maybe].view(np.uint64))
                total = lambda x: np.bincount(doc, weights=x, minlength=count)  # noqa: B023, E731
                own = ids[first:first + count]
                of = pa.StructArray.from_arrays([
                    names.slice(first, count), pa.array(total(score)), pa.array(total(base)),
                    pa.array(sizes.astype(np.int64)), pa.array(total(known).astype(np.int64))],
                    ["doc_id", "score", "base", "n_tokens", "n_known"])
                # A document's own row is spread by its id: the key of no pair, or of one that its sums ignore.
                spread = mixed(own.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(own), pa.nulls(count, pa.bool_()), of], ["k", "id", "training", "of"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[asked]), pa.array(own[doc[asked]]), pa.array(mine[asked]), pa.nulls(int(asked.sum()), of.type)],
                    ["k", "id", "training", "of"])

    return rows.mapInArrow(run, f"k long, id long, training boolean, of {_OF}")


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of (doc_id, text).

    Rows whose crc32 of doc_id, as text, is divisible by 10 are held out; the
    others are the training set, each repeated row by itself. A null doc_id
    counts as the empty text, so it is held out. Without a training set every
    score is that of the uniform base.
    """
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = spark.sparkContext.broadcast
    hot = frequent_words(texts)
    counts, counts_path = written(tallies(texts, np.sort(hot.toArrow()["w"].to_numpy())), "tallies")
    release(spark)
    words = counts.where(F.col("kind") == WORD)
    model = fitted(counts.where(F.col("kind") != WORD), words.select("w", F.col("n").alias("c")))
    everything = words.agg(F.sum("m").alias("m")).first().m or 0
    law, both = sent(model.vocabulary(hot)), F.col("kind") == BOTH
    plain = model.scored(model.blocks.where(~both)).select(
        "k", "m", F.col("score").alias("seen"), F.col("score").alias("unseen"), "base", F.col("known").cast("long").alias("known"), F.lit(False).alias("both"))
    added = corrections(model.blocks.where(both).select("k", "w", "ctx", "m", "lead"), law, model.d).select(
        "k", "m", "seen", "unseen", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), F.lit(True).alias("both"))
    scored, _ = written(plain.union(added), "hpylm")
    for path in (counts_path, *model.paths):
        discard(spark, path)
    release(spark)
    often = F.col("m") * HOT >= everything
    frequent = sent(Frequent(scored.where(often).select("k", "seen", "unseen", "base", "known").toArrow()))
    bits = sent(filter_bits(scored.where(~often & F.col("both")), F.col("k")))
    release(spark)
    routed = _routed(texts.withColumn("training", ~held_out(F.col("doc_id"))), law, frequent, bits, model.d)
    told = routed.join(scored.where(~often).select("k", "seen", "unseen", "base", "known"), "k", "left")
    own = F.col("of").isNotNull()
    sums = {"n_known": F.when(own, F.col("of.n_known")).otherwise(F.col("known")),
            "base_score": F.when(own, F.col("of.base")).otherwise(F.col("base")),
            "score": F.when(own, F.col("of.score")).when(F.col("training"), F.col("seen")).otherwise(F.col("unseen"))}
    whole = told.groupBy("id").agg(
        F.max("of.doc_id").alias("doc_id"), F.sum("of.n_tokens").alias("n_tokens"), *(F.sum(c).alias(name) for name, c in sums.items()))
    return whole.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
                        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
