"""Language-model scores from a hierarchical Pitman-Yor model of words in context and of their spellings.

Restaurants of words: one for each frequent word before, one for each class of the rarer words before, one for the start of
a text; all share one parent, the restaurant without context. A word is frequent if it makes up SHARE of the training
tokens, so at most 1 / SHARE are. Classes are learned from the training text: endings (the last two bytes) of words are
clustered by the endings that follow them. The shared restaurant's base measure is half uniform over the known words and
one unknown, half a letter model of the known words' spellings (a hierarchy of contexts of three letters, two, one and none).

Seating is sampled by blocked Gibbs sweeps: in each sweep all customers of all dishes, of words and of letters, leave and sit
down again. Given the parent's measure and one gamma variable of each restaurant (whose mean is its tables, plus strength by
discount), dishes are independent, and a dish of c customers has t tables with probability proportional to weight**t times
the generalised Stirling number of (c, t): `tables` draws from that law whatever c is. The parent's measure is drawn from
its own seating (gamma shares of its dishes; of what it leaves to new tables each word has its expected share). New tables
are the parent's customers; of a word's tables in the shared restaurant a binomial part comes from the letter model and sends
its letters there, whose restaurants then move likewise. After every sweep the strengths and discounts are sampled, by
auxiliary variables. Predictive probabilities are averaged over the last sweeps.

Counts stay distributed. A block of documents asks for its distinct (word, context) pairs once; the pairs of all blocks
meet by bucket, where they are counted, seated and answered; answers return to the block's documents. Buckets hold a
bounded amount of text on average, whatever the size of the corpus. The driver sees totals of contexts (bounded by SHARE),
the table of endings (at most SLOTS squared counts) and the letter counts, which are bounded by the alphabet.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import document_crc, dropped, lowered, mixed, prefix_hash, range_hash, release, slices, spans, written

SWEEPS, KEPT = 4, 2
#: Customers up to which Stirling numbers stand in a table; dishes and points of the contour of one step above.
SMALL, AT_ONCE, POINTS = 64, 128, 40
LETTER_STRENGTH, LETTER_DISCOUNT = 2.0, 0.6
#: Strength and discount of contexts and of the shared restaurant that sampling starts from.
START_AT = (5.0, 0.6, 10.0, 0.6)
#: Share of the training tokens from which on a word has a restaurant of its own for the words that follow it.
SHARE = 2.5e-5
#: Classes of the other words before, and hash slots of word endings.
CLASSES, SLOTS = 16, 1024
END, START, LETTERS, ALPHABET = 256, 257, 257, 258
#: The oldest letter of a context is told apart in so many classes.
OLDEST = 32
#: Bytes of text that make a block, and for which there is a bucket.
BLOCK_BYTES, BUCKET_BYTES = 16_000_000, 12_000_000
#: Answers are log10 probabilities in steps of this size, in 16 bits.
STEP = 1 / 2000


def tidied(run):
    """A task that leaves no memory to the worker's next tasks, nor finds any of its earlier ones."""

    def tidy(batches):
        release()
        yield from run(batches)
        release()

    return tidy


def pack(x: np.ndarray) -> bytes:
    """Compressed bytes of an array, after their length."""
    raw = np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(cell: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(cell[8:], int.from_bytes(cell[:8], "little"), codec="zstd", asbytes=True), kind)


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of dishes after their customers sat down in turn; weight is (strength + discount * tables) * parent's probability.

    The first customer takes a table; the j-th a new one with probability weight / (weight + seated - discount * tables).
    From the 20th on, customers sit down in parties of a twentieth of those seated, each with the same chance."""
    tables = (customers > 0).astype(np.float64)
    live = np.flatnonzero(customers > 1)
    j = 1
    while len(live):
        party = 1 if j < 20 else j // 20
        n = np.minimum(customers[live] - j, party)
        w = weight[live]
        p = np.clip(w / (w + j - discount * tables[live]), 0, 1)
        tables[live] += rng.random(len(live)) < p if party == 1 else rng.binomial(n.astype(np.int64), p)
        j += party
        live = live[customers[live] > j]
    return tables


def stirling(discount: float, most: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Logs of the generalised Stirling numbers [c, t], c, t <= most, and their derivatives by the discount."""
    n, slope = np.zeros((most + 1, most + 1)), np.zeros((most + 1, most + 1))
    n[1, 1] = 1
    t = np.arange(1, most + 1)
    for c in range(1, most):
        n[c + 1, 1:] = n[c, :-1] + (c - t * discount) * n[c, 1:]
        slope[c + 1, 1:] = slope[c, :-1] + (c - t * discount) * slope[c, 1:] - t * n[c, 1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log(n), slope / n


def _large(c: np.ndarray, weight: np.ndarray, d: float, rng) -> tuple[np.ndarray, float]:
    """`tables` of dishes of many customers. weight**t times the Stirling number is c! times the coefficient of z**c in
    (weight * f)**t / t!, f = (1 - (1 - z)**d) / d. Cauchy's integral gives it for all t that have a probability, on a contour through
    the saddle point of their sum: a circle around z = 0, or where that comes near the cut y = 1 - z <= 0, a parabola around the cut."""
    # the saddle, y = 1 / (1 + exp(v)), where weight * (1 - y) * y**(d - 1) = c
    goal = np.log(c) - np.log(weight)
    v = np.where(goal > 0, goal / (1 - d), goal)
    for _ in range(30):
        high = np.logaddexp(0, v)
        v = v - (v - high + (1 - d) * high - goal) / (1 - d * np.exp(v - high))
    v = np.minimum(v, 69)  # no smaller y makes a difference
    y1, z1 = np.exp(-np.logaddexp(0, v)), np.exp(-np.logaddexp(0, -v))
    part = -np.expm1(-d * np.logaddexp(0, v))
    mean = weight * part / d
    circle = y1 > 0.5
    y0 = np.maximum(y1, 2 / c)
    bend = weight * y1 ** (d - 1) / z1 + weight * (1 - d) * y1 ** (d - 2) - weight * d * y1 ** (2 * d - 2) / part
    fall = np.where(y1 >= 2 / c, np.minimum(c * y0, 2 * bend * y0**2), c * y0)
    spread = c * np.maximum(1 + (1 - d) * z1 / y1 - z1 * y1 ** (d - 1) * d / part, 0)
    # as a compound Poisson number of tables, given its total
    off = 7 * np.sqrt(mean * spread / (spread + c * c / np.maximum(mean, 1e-200)) + 1) + 8
    low = np.maximum(1, np.floor(mean - off)).astype(np.int64)
    wide = np.minimum(c, np.ceil(mean + off)).astype(np.int64) - low + 1
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(circle, np.minimum(np.pi, 8 / np.sqrt(spread)), np.sqrt(36 / fall))
    out, slope = np.zeros(len(c), np.int64), 0.0
    order = np.argsort(wide)
    for i in range(0, len(c), AT_ONCE):
        at = order[i : i + AT_ONCE]
        s, round_ = reach[at, None] * np.linspace(0, 1, POINTS), circle[at, None]
        turn = np.where(round_, np.exp(1j * s), 1 + 1j * s)
        z = np.where(round_, z1[at, None] * turn, 1 - y0[at, None] * turn**2)
        log_y = np.where(round_, np.log1p(-np.where(round_, z, 0)), 2 * np.log(turn) + np.log(y0[at, None]))
        f = -np.expm1(d * log_y) / d
        around = -(c[at, None] + 1) * np.log(z)
        turn[:, 0] /= 2
        turn[:, -1] /= 2
        term = lambda t: np.exp((x := t[:, None] * np.log(f) + around) - x[:, :1].real) * turn  # noqa: B023, E731
        now = term(low[at])
        p = np.zeros((len(at), wide[at[-1]]))
        for k in range(p.shape[1]):
            p[:, k] = now.real.sum(axis=1)
            now *= weight[at, None] * f / (low[at] + k + 1)[:, None]
        p[np.arange(p.shape[1]) >= wide[at, None]] = 0
        upto = np.cumsum(np.maximum(p, 0), axis=1)
        t = low[at] + (upto <= (rng.random(len(at)) * upto[:, -1])[:, None]).sum(axis=1)
        out[at] = t
        now = term(t)
        by_d = t[:, None] * (-np.exp(d * log_y) * log_y / (d * f) - 1 / d)
        slope += float(((now * by_d).real.sum(axis=1) / now.real.sum(axis=1)).sum())
    return out, slope


def tables(customers: np.ndarray, weight: np.ndarray, discount: float, rng) -> tuple[np.ndarray, float]:
    """Tables of dishes after all their customers left and sat down again, t with probability proportional to weight**t times the
    generalised Stirling number of (customers, t); and the sum of the derivatives of those numbers' logs by the discount."""
    out, slope = (customers > 0).astype(np.int64), 0.0
    number, by_d = stirling(discount)
    weight = np.maximum(weight, 1e-300)
    few = np.minimum(customers, SMALL + 1)
    order = np.argsort(few, kind="stable")
    edge = np.searchsorted(few[order], np.arange(2, SMALL + 2))
    for c in range(2, SMALL + 1):
        at = order[edge[c - 2] : edge[c - 1]]
        if len(at):
            p = np.log(weight[at])[:, None] * np.arange(1, c + 1) + number[c, 1 : c + 1]
            upto = np.cumsum(np.exp(p - p.max(axis=1)[:, None]), axis=1)
            t = 1 + (upto <= (rng.random(len(at)) * upto[:, -1])[:, None]).sum(axis=1)
            out[at] = t
            slope += float(by_d[c, t].sum())
    at = order[edge[-1] :]
    if len(at):
        out[at], more = _large(customers[at].astype(np.float64), weight[at], discount, rng)
        slope += more
    return out, slope


def letters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, symbol, context of three) of every letter and end of the words."""
    m = len(offs) - 1
    size = np.diff(offs) + 1
    begin = np.concatenate(([0], np.cumsum(size)))
    word = np.repeat(np.arange(m), size)
    sym = np.full(begin[-1], END, np.int64)
    at = np.arange(len(data)) + np.repeat(np.arange(m), size - 1)
    sym[at] = data
    pos = np.arange(len(sym)) - begin[word]
    prev = [np.where(pos >= k, np.concatenate((np.full(k, START), sym[:-k])) if len(sym) >= k else START, START) for k in (1, 2, 3)]
    return word, sym, ((prev[1] * ALPHABET + prev[0]) * OLDEST + prev[2] * 7 % OLDEST)


@dataclass
class Spelling:
    """Probabilities of letters given up to three before them."""

    p1: np.ndarray  # [letter before, letter]
    key2: np.ndarray
    p2: np.ndarray
    rest2: np.ndarray  # by context of two: share that goes to the parent
    key3: np.ndarray
    p3: np.ndarray
    ctx3: np.ndarray
    rest3: np.ndarray
    tables: tuple = ()  # of contexts of three (in the order of ctx3), of two, of one, of none
    drawn: Spelling | None = None  # the same with measures drawn from the seating, where these are their means

    @classmethod
    def uniform(cls) -> Spelling:
        none, real = np.zeros(0, np.int64), np.zeros(0)
        return cls(np.full((ALPHABET, LETTERS), 1 / LETTERS), none, real, np.ones(ALPHABET**2), none, real, none, real)

    def p0(self) -> np.ndarray:
        """Probabilities of letters without context: those of a letter that nothing followed, END's row."""
        return self.p1[END]

    def _two(self, ctx2, sym):
        p = self.rest2[ctx2] * self.p1[ctx2 % ALPHABET, sym]
        if len(self.key2):
            k = ctx2 * LETTERS + sym
            at = np.minimum(np.searchsorted(self.key2, k), len(self.key2) - 1)
            p = np.where(self.key2[at] == k, self.p2[at], p)
        return p

    def probability(self, ctx3, sym):
        if not len(self.key3):
            return self._two(ctx3 // OLDEST, sym)
        k = ctx3 * LETTERS + sym
        at = np.minimum(np.searchsorted(self.key3, k), len(self.key3) - 1)
        hit = self.key3[at] == k
        p = self.p3[at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            c = ctx3[miss]
            r = np.minimum(np.searchsorted(self.ctx3, c), len(self.ctx3) - 1)
            p[miss] = np.where(self.ctx3[r] == c, self.rest3[r], 1.0) * self._two(c // OLDEST, sym[miss])
        return p

    def words(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Natural log probability of each word's spelling."""
        word, sym, ctx = letters(data, offs)
        return np.bincount(word, np.log(self.probability(ctx, sym)), len(offs) - 1)

    @classmethod
    def seated(cls, key3: np.ndarray, count: np.ndarray, before: Spelling, seed: int) -> Spelling:
        """The next sweep's restaurants: customers of contexts of three, whose tables are the customers of two, and so on. All leave
        and sit down again, given the measures drawn from the seating before."""
        if not len(key3):
            return cls.uniform()
        rng = np.random.default_rng(seed)
        d, s = LETTER_DISCOUNT, LETTER_STRENGTH
        given, shares = before.drawn or before, []

        def level(group, groups, c, parent, tables_before):
            """Tables; kept for each group: (share of own counts, share of the parent), as means and drawn."""
            t = tables(c, d * rng.standard_gamma(tables_before + s / d)[group] * parent, d, rng)[0]
            total, many = np.bincount(group, c, groups), np.bincount(group, t, groups)
            own, rest = rng.standard_gamma(c - d * t), rng.standard_gamma(s + d * many)
            all_ = np.bincount(group, own, groups) + rest
            shares.append((((c - d * t) / (s + total[group]), (s + d * many) / (s + total)), (own / all_[group], rest / all_), many))
            return t

        sym, ctx3 = key3 % LETTERS, key3 // LETTERS
        groups, group = np.unique(ctx3, return_inverse=True)
        key2, at2 = np.unique(ctx3 // OLDEST * LETTERS + sym, return_inverse=True)
        ctx2, sym2 = key2 // LETTERS, key2 % LETTERS
        key1, at1 = np.unique(ctx2 % ALPHABET * LETTERS + sym2, return_inverse=True)
        ctx1, sym1 = key1 // LETTERS, key1 % LETTERS
        # to start from, a table for each letter of a context; new contexts of three have none
        many = before.tables or (np.zeros(0), np.bincount(ctx2, minlength=ALPHABET**2), np.bincount(ctx1, minlength=ALPHABET), np.array([len(np.unique(sym1))]))
        many3 = np.bincount(group).astype(float)
        if len(before.ctx3):
            at = np.minimum(np.searchsorted(before.ctx3, groups), len(before.ctx3) - 1)
            many3 = np.where(before.ctx3[at] == groups, many[0][at], 0)
        t3 = level(group, len(groups), count.astype(np.int64), given._two(ctx3 // OLDEST, sym), many3)
        t2 = level(ctx2, ALPHABET**2, np.bincount(at2, t3).astype(np.int64), given.p1[ctx2 % ALPHABET, sym2], many[1])
        c1 = np.bincount(at1, t2).astype(np.int64)
        t1 = level(ctx1, ALPHABET, c1, given.p0()[sym1], many[2])
        level(np.zeros(LETTERS, np.int64), 1, np.bincount(sym1, t1, LETTERS).astype(np.int64), np.full(LETTERS, 1 / LETTERS), many[3])

        def built(kind, drawn=None):
            (own3, rest3), (own2, rest2), (own1, rest1), (own0, rest0) = (x[kind] for x in shares)
            p1 = rest1[:, None] * (own0 + rest0[0] / LETTERS)[None, :]
            p1[ctx1, sym1] += own1
            out = cls(p1, key2, np.zeros(0), rest2, key3, np.zeros(0), groups, rest3, tuple(x[2] for x in shares), drawn)
            out.p2 = own2 + rest2[ctx2] * p1[ctx2 % ALPHABET, sym2]
            out.p3 = own3 + rest3[group] * out._two(ctx3 // OLDEST, sym)
            return out

        return built(0, built(1))


class Seats:
    """Tables of many dishes and their sizes; at most one customer of a dish moves at a time. The law of `tables`, one move after another."""

    def __init__(self, tables: np.ndarray, sizes: np.ndarray, spare: int = 6):
        self.t, self.used, self.spare = tables.astype(np.int64), tables.astype(np.int64), spare
        self.c = np.bincount(np.repeat(np.arange(len(tables)), tables), sizes, len(tables)).astype(np.int64)
        self._lay(sizes)

    def _lay(self, sizes: np.ndarray) -> None:
        self.room = self.used + self.spare
        self.start = np.cumsum(self.room) - self.room
        self.size = np.zeros(int(self.room.sum()), np.int64)
        self.size[self._slots()] = sizes

    def _slots(self) -> np.ndarray:
        return np.repeat(self.start - (np.cumsum(self.used) - self.used), self.used) + np.arange(int(self.used.sum()))

    def sizes(self) -> np.ndarray:
        """Sizes of the tables in use, by dish."""
        out = self.size[self._slots()]
        return out[out > 0]

    def _table(self, at: np.ndarray, rng) -> np.ndarray:
        """The table of a random customer of each of the dishes."""
        pick = np.minimum((rng.random(len(at)) * self.c[at]).astype(np.int64), self.c[at] - 1)
        n = self.used[at]
        slots = np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        upto = np.cumsum(self.size[slots])
        ends = np.cumsum(n)
        return slots[np.searchsorted(upto, upto[ends - 1] - self.c[at] + pick, "right")]

    def leave(self, at: np.ndarray, rng) -> np.ndarray:
        """A random customer of each dish leaves; whether its table closes."""
        k = self._table(at, rng)
        self.size[k] -= 1
        self.c[at] -= 1
        closed = self.size[k] == 0
        self.t[at] -= closed
        return closed

    def sit(self, at: np.ndarray, weight: np.ndarray, discount: float, rng) -> np.ndarray:
        """A customer comes to each dish: to a new table by weight, to an old one by its size less the discount. Whether it is new."""
        if (self.used[at] >= self.room[at]).any():
            sizes = self.sizes()
            self.used = self.t.copy()
            self._lay(sizes)
        new = rng.random(len(at)) * (weight + np.maximum(self.c[at] - discount * self.t[at], 0)) < weight
        new |= self.c[at] == 0
        opened = at[new]
        self.size[self.start[opened] + self.used[opened]] = 1
        self.used[opened] += 1
        self.t[opened] += 1
        left = at[~new]
        while len(left):
            k = self._table(left, rng)
            ok = rng.random(len(k)) * self.size[k] < self.size[k] - discount
            self.size[k[ok]] += 1
            left = left[~ok]
        self.c[at] += 1
        return new


@dataclass
class State:
    """Totals over all buckets after a sweep, and the strengths and discounts sampled from them."""

    tables: np.ndarray  # of each context
    root_tables: float
    root_customers: float
    strength: float
    discount: float
    root_strength: float
    root_discount: float
    own: float  # what the words' gamma shares of the parent's measure are expected to sum up to
    seed: int

    def weights(self) -> tuple[np.ndarray, float, float]:
        """The sweep's weights of contexts and of the shared restaurant, and the share that its measure leaves to new tables."""
        rng = np.random.default_rng([self.seed, 0])
        s, d = self.root_strength, self.root_discount
        opens = self.discount * rng.standard_gamma(self.tables + self.strength / self.discount)
        rest = rng.standard_gamma(s + d * self.root_tables)
        return opens, d * float(rng.standard_gamma(self.root_tables + s / d)), float(rest)


@dataclass
class Totals:
    """What doesn't change: training tokens and types, customers of each context, the letter model."""

    tokens: int
    types: int
    customers: np.ndarray
    spelling: Spelling

    def base(self, data: np.ndarray, offs: np.ndarray, drawn: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Base measure of the words, and the part of it that is the letter model's."""
        spelt = 0.5 * np.exp(((drawn and self.spelling.drawn) or self.spelling).words(data, offs))
        return (all_ := 0.5 / (self.types + 1) + spelt), spelt / all_


#: Words' hashes, numbers of pairs of each word, spellings and their lengths, contexts and training counts of the pairs.
_PARTS = ("a", "b", "c", "d", "e", "f")
#: Words' base measure, summed over the sweeps kept; tables of the pairs that occur twice or more; tables of words.
_STATE = ("base", "t2", "t1")


class Bucket:
    """The pairs of a bucket by (word, context), with the spellings of its words."""

    def __init__(self, number: int, row):
        self.number, self.row = number, row
        self.hash, wide = unpack(row[0], np.uint64), unpack(row[1], np.uint32)
        self.data = unpack(row[2], np.uint8)
        self.offs = np.concatenate(([0], np.cumsum(unpack(row[3], np.uint32).astype(np.int64))))
        self.word = np.repeat(np.arange(len(self.hash)), wide)
        self.context, self.count = unpack(row[4], np.uint16).astype(np.int64), unpack(row[5], np.int64)
        self.live = np.flatnonzero(self.count > 1)

    def by_word(self, n: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, n, len(self.hash))

    def pair_tables(self, t2: np.ndarray) -> np.ndarray:
        """Tables of all pairs: those of one customer have one."""
        out = (self.count > 0).astype(np.int64)
        out[self.live] = t2
        return out

    def root(self, c, t, base, s: State) -> np.ndarray:
        """Predictive probabilities of the words without context."""
        return (np.maximum(c - s.root_discount * t, 0) + (s.root_strength + s.root_discount * s.root_tables) * base) / (s.root_strength + s.root_customers)

    def shares(self, t2: np.ndarray, t1: np.ndarray, s: State, seed: int) -> np.ndarray:
        """Gamma shares of the words in the measure of the shared restaurant, drawn from its seating."""
        return np.random.default_rng([seed, 1, self.number]).standard_gamma(np.maximum(self.by_word(self.pair_tables(t2)) - s.root_discount * t1, 0))

    def sweep(self, t2: np.ndarray, t1: np.ndarray, all_: Totals, s: State, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        """A Gibbs sweep: all customers of all dishes leave and sit down again. Tables of pairs, of words, those of them that come
        from the letter model, and what the discounts are sampled from."""
        base, spelt = all_.base(self.data, self.offs, drawn=True)
        opens, root, rest = s.weights()
        p = (self.shares(t2, t1, s, s.seed) + rest * base) / (s.own + rest)
        t2, apart = tables(self.count[self.live], opens[self.context[self.live]] * p[self.word[self.live]], s.discount, rng)
        t1, root_apart = tables(self.by_word(self.pair_tables(t2)).astype(np.int64), root * base, s.root_discount, rng)
        return t2, t1, rng.binomial(t1, np.clip(spelt, 0, 1)), max(0.0, -(1 - s.discount) * apart), max(0.0, -(1 - s.root_discount) * root_apart)

    def letters(self, n: np.ndarray, total: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Letter counts of n of each word, added to a total."""
        word, sym, ctx = letters(self.data, self.offs)
        at = np.flatnonzero(n[word])
        key, inverse = np.unique(ctx[at] * LETTERS + sym[at], return_inverse=True)
        u, place = np.unique(np.concatenate((total[0], key)), return_inverse=True)
        return u, np.bincount(place, np.concatenate((total[1], np.bincount(inverse, n[word[at]], len(key)))), len(u))

    def probabilities(self, base: np.ndarray, kept: list[tuple[np.ndarray, np.ndarray]], states: list[State], all_: Totals) -> np.ndarray:
        """Averaged predictive probability of each pair's word in its context."""
        out = np.zeros(len(self.count))
        for (t2, t1), s in zip(kept, states, strict=True):
            t = self.pair_tables(t2)
            p = self.root(self.by_word(t), t1, base, s)
            own = np.maximum(self.count - s.discount * t, 0) + (s.strength + s.discount * s.tables[self.context]) * p[self.word]
            out += own / (s.strength + all_.customers[self.context])
        return out / len(states)


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(6):
        out -= 1 / x
        x = x + 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def sampled(customers: np.ndarray, tables: np.ndarray, apart: float, strength: float, discount: float, rng) -> tuple[float, float]:
    """New strength and discount of restaurants that share them, given their tables, by auxiliary variables whose
    sums over tables are drawn as Poisson numbers of the same means; apart is the mean of one of them, summed over all seatings
    with these tables."""
    some = tables > 0
    c, t = customers[some], tables[some]
    if not len(t):
        return strength, discount
    by_strength = (strength / discount * (digamma(t + strength / discount) - digamma(strength / discount + 1.0))).sum()
    apart_tables = max(0.0, float((t - 1).sum() - by_strength))
    new = rng.beta(1 + rng.poisson(apart_tables), 1 + rng.poisson(apart))
    x = rng.beta(strength + 1, np.maximum(c - 1, 1e-3))
    theta = rng.gamma(1 + rng.poisson(max(0.0, float(by_strength))), 1 / (1 - np.log(np.maximum(x, 1e-300)).sum()))
    return float(np.clip(theta, 0.05, 1e6)), float(np.clip(new, 0.05, 0.95))


def endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Slots of the words' last two bytes."""
    if not len(starts):
        return np.zeros(0, np.int64)
    last = data[ends - 1].astype(np.uint64)
    code = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)].astype(np.uint64) * np.uint64(256) + last, last)
    return (mixed(code) % np.uint64(SLOTS)).astype(np.int64)


#: Kinds of counts that tasks send: customers and tables of contexts, scalars, letters.
_TABLES, _SCALARS, _LETTER_KEYS = 1 << 17, 1 << 18, 1 << 20


def _survey(batches):
    """kind 0: (slot * SLOTS + slot of the next word, n); kind 1: words of a batch, by hash, with their counts;
    kind 2: 0 for training tokens, 1 for bytes of all texts."""
    n, tokens, size = np.zeros(SLOTS * SLOTS, np.int64), 0, 0
    rows = lambda kind, key, n: pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind), pa.int32()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["kind", "key", "n"])
    for batch in batches:
        size += int(pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0)
        hashes, mine = [np.zeros(0, np.uint64)], 0
        for _, _, data, offs in slices(batch.filter(pc.invert(batch.column("held_out"))).column("text")):
            data = lowered(data)
            starts, ends, row = spans(data, offs)
            hashes.append(range_hash(prefix_hash(data), starts, ends))
            mine += len(starts) + len(offs) - 1
            code = endings(data, starts, ends)
            pair = (code[:-1] * SLOTS + code[1:])[row[1:] == row[:-1]]
            n += np.bincount(pair, minlength=SLOTS * SLOTS)
        tokens += mine
        word, times = np.unique(np.concatenate(hashes), return_counts=True)
        yield rows(1, word.view(np.int64), times)
    some = np.flatnonzero(n)
    yield rows(0, some, n[some])
    yield rows(2, np.arange(2), np.array([tokens, size]))


def ending_classes(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Class of each slot: weighted k-means of the square roots of what follows it, from far-apart frequent slots."""
    m = np.bincount(key, n, SLOTS * SLOTS).reshape(SLOTS, SLOTS)
    weight = m.sum(axis=1)
    x = np.sqrt((m + 0.01 * m.sum(axis=0) / max(1, m.sum())) / np.maximum(weight + 0.01, 1e-9)[:, None])
    used = np.flatnonzero(weight > 0)
    if not len(used):
        return np.zeros(SLOTS, np.int64)
    centres = [x[used[weight[used].argmax()]]]
    far = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(1, min(CLASSES, len(used))):
        centres.append(x[(far * np.sqrt(weight)).argmax()])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(15):
        near = (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        for k in range(len(c)):
            mine = near == k
            if weight[mine].sum() > 0:
                c[k] = (x[mine] * weight[mine, None]).sum(axis=0) / weight[mine].sum()
    return near


def _packed(strings: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ranges put together, and their lengths."""
    n = ends - starts
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    return strings[at], n.astype(np.uint32)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes."""
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _blocks(buckets: int, class_of: np.ndarray, frequent: np.ndarray):
    """kind 0: a block's distinct (word, context) pairs of a bucket with their training counts; kind 1: some of its documents
    as numbers of the block's pairs. Contexts: frequent words, then classes, then the start of a text."""

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        number = 0
        for batch in batches:
            size = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)))
            lo = 0
            while lo < batch.num_rows:
                hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(size, size[lo] + BLOCK_BYTES, "right")) - 1))
                yield from block(batch.slice(lo, hi - lo), part + number)
                number, lo = number + 1, hi

    def block(b, block_id):
        train = ~b.column("held_out").to_numpy(zero_copy_only=False)
        hashes, rows, befores, words = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint16)], [(np.zeros(1, np.uint64), np.zeros(0, np.uint8), np.zeros(1, np.uint32))]
        for i, _, data, offs in slices(b.column("text")):
            data = lowered(data)
            starts, ends, row = spans(data, offs)
            h = range_hash(prefix_hash(data), starts, ends)
            u, first = np.unique(h, return_index=True)
            words.append((u, *_packed(data, starts[first], ends[first])))
            context = len(frequent) + class_of[endings(data, starts, ends)]
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                context = np.where(frequent[at] == h, at, context)
            hashes.append(h)
            rows.append((row + i).astype(np.int32))
            befores.append(context.astype(np.uint16))
        h, row, after = np.concatenate(hashes), np.concatenate(rows), np.concatenate(befores)
        del hashes, rows, befores
        # every text's words, then its end (hash 0, the word without letters)
        size = np.bincount(row, minlength=b.num_rows) + 1
        at = np.arange(len(h)) + row
        all_h, before = np.zeros(len(h) + b.num_rows, np.uint64), np.full(len(h) + b.num_rows, len(frequent) + CLASSES, np.int64)
        all_h[at] = h
        before[at + 1] = after
        del h, row, after, at
        known, word = np.unique(all_h, return_inverse=True)
        del all_h
        distinct, number = np.unique((word << 16) | before, return_inverse=True)
        del word, before
        count = np.bincount(number, np.repeat(train, size), len(distinct)).astype(np.int64)
        word, context = distinct >> 16, (distinct & 0xFFFF).astype(np.uint16)
        # spellings of the distinct words, in that order
        seen = np.concatenate([w[0] for w in words])
        length = np.concatenate([w[2] for w in words]).astype(np.int64)
        text = np.concatenate([w[1] for w in words])
        del words, distinct
        first = np.unique(seen, return_index=True)[1]
        begin = np.cumsum(length) - length
        wide = np.bincount(word, minlength=len(known))
        edge = np.searchsorted(bucket_of(known, buckets), np.arange(buckets + 1))
        to = np.concatenate(([0], np.cumsum(wide)))
        out: list[list] = [[] for _ in _NAMES]
        for k in np.flatnonzero(np.diff(edge)).tolist():
            s, e = edge[k], edge[k + 1]
            w = first[s:e]
            raw, n = _packed(text, begin[w], begin[w] + length[w])
            pairs = slice(to[s], to[e])
            for col, v in zip(out, (block_id, 0, k, pack(known[s:e]), pack(wide[s:e].astype(np.uint32)), pack(raw), pack(n), pack(context[pairs]), pack(count[pairs])), strict=True):
                col.append(v)
        yield _rows(out)
        del text, seen, length, first, begin, known, word, context, count
        ids = b.column("doc_id")
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        ends = np.concatenate(([0], np.cumsum(size)))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + 300_000, "right")) - 1)
            # each text's ascending numbers as steps, their low and high halves apart, and how often each occurs
            doc = np.repeat(np.arange(hi - lo), size[lo:hi])
            key, times = np.unique((doc << 32) | number[ends[lo] : ends[hi]], return_counts=True)
            step = np.diff(key & 0xFFFFFFFF, prepend=0)
            lens = np.bincount(key >> 32, minlength=hi - lo)
            heads = np.cumsum(lens) - lens
            step[heads] = key[heads] & 0xFFFFFFFF
            doc_rows = np.stack((ids[lo:hi], null[lo:hi] * 2 + ~train[lo:hi], lens))
            yield _rows([[block_id], [1], [None], [pack((step & 0xFFFF).astype(np.uint16))], [pack((step >> 16).astype(np.uint16))], [pack(times.astype(np.uint32))], [pack(doc_rows.astype(np.int64))], [None], [None]])
            lo = hi

    return run


_NAMES = ["block", "kind", "bucket", *_PARTS]
_KINDS = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
_SCHEMA = "block long, kind int, bucket int, a binary, b binary, c binary, d binary, e binary, f binary"


def _rows(out):
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, _KINDS, strict=True)], names=_NAMES)


_BUCKET_SCHEMA = "bucket int, " + ", ".join(f"{c} binary" for c in (*_PARTS, *_STATE)) + ", kept array<binary>, keys array<long>, sums array<double>"


def _bucket_row(number, parts, state, kept, keys, sums):
    kinds = [pa.int32(), *[pa.binary()] * (len(_PARTS) + len(_STATE)), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.float64())]
    values = [number, *parts, *state, kept, np.asarray(keys), np.asarray(sums)]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["bucket", *_PARTS, *_STATE, "kept", "keys", "sums"])


def _merge(batches):
    """One row of a bucket: pairs by (word, context) with counts, and the words' spellings; with the customers of its contexts,
    and as tables the pairs, as if each had one. Rows come sorted by bucket. Last, a row of no bucket with the letter counts."""
    now, held, total = None, [], (np.zeros(0, np.int64), np.zeros(0))

    def merged():
        hashes = [unpack(r[0], np.uint64) for r in held]
        known, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        key = (np.repeat(inverse, np.concatenate([unpack(r[1], np.uint32) for r in held])) << 16) | np.concatenate([unpack(r[4], np.uint16) for r in held])
        n = np.concatenate([unpack(r[3], np.uint32) for r in held]).astype(np.int64)
        begin = np.cumsum(n) - n
        raw, size = _packed(np.concatenate([unpack(r[2], np.uint8) for r in held]), begin[first], begin[first] + n[first])
        key, inverse = np.unique(key, return_inverse=True)
        count = np.bincount(inverse, np.concatenate([unpack(r[5], np.int64) for r in held]), len(key)).astype(np.int64)
        wide = np.bincount(key >> 16, minlength=len(known)).astype(np.uint32)
        return [pack(x) for x in (known, wide, raw, size, (key & 0xFFFF).astype(np.uint16), count)]

    def row():
        nonlocal total
        b = Bucket(now, held[0])
        customers, tables = np.bincount(b.context, b.count), np.bincount(b.context, b.count > 0)
        some = np.flatnonzero(customers)
        types = b.by_word(b.count > 0)
        total = b.letters((types > 0).astype(np.int64), total)
        keys = np.concatenate((some, some + _TABLES, _SCALARS + np.arange(2)))
        sums = np.concatenate((customers[some], tables[some], [(types > 0).sum(), types.sum()]))
        return _bucket_row(now, held[0], [None] * len(_STATE), [], keys, sums)

    for batch in batches:
        for k, *x in zip(*[batch.column(c).to_pylist() for c in ("bucket", *_PARTS)], strict=True):
            if k != now and held:
                held = [merged()]
                yield row()
                held = []
            now = k
            held.append(x)
            if len(held) >= 64:  # so that memory follows the distinct pairs, not the blocks
                held = [merged()]
    if held:
        held = [merged()]
        yield row()
    yield _bucket_row(None, [None] * len(_PARTS), [None] * len(_STATE), [], total[0] + _LETTER_KEYS, total[1])


def _sweep(sent, keep: bool):
    """A Gibbs sweep of every bucket, with its new tables and what they add to the totals. Last, a row of no bucket with the
    letter counts of the words' tables that come from the letter model."""

    def run(batches):
        all_, s = sent.value
        total = (np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            for k, *x in zip(*[batch.column(c).to_pylist() for c in ("bucket", *_PARTS, *_STATE, "kept")], strict=True):
                parts, (base, *state), kept = x[: len(_PARTS)], x[len(_PARTS) : -1], x[-1]
                b = Bucket(k, parts)
                if state[0] is None:  # to start from, everyone has a table
                    t2, t1 = np.ones(len(b.live), np.int64), (b.by_word(b.count > 0) > 0).astype(np.int64)
                else:
                    t2, t1 = (unpack(v, np.int64) for v in state)
                t2, t1, spelt, apart, root_apart = b.sweep(t2, t1, all_, s, np.random.default_rng([s.seed, 2, k]))
                total = b.letters(spelt, total)
                tables_ = np.bincount(b.context, b.pair_tables(t2))
                some = np.flatnonzero(tables_)
                keys = np.concatenate((some + _TABLES, _SCALARS + np.arange(4)))
                sums = np.concatenate((tables_[some], [t1.sum(), b.pair_tables(t2).sum(), apart, root_apart]))
                now = [pack(t2), pack(t1)]
                if keep:
                    mean = all_.base(b.data, b.offs)[0] / KEPT
                    base = pack(mean if base is None else unpack(base, np.float64) + mean)
                yield _bucket_row(k, parts, [base, *now], [*kept, *now] if keep else [], keys, sums)
        yield _bucket_row(None, [None] * len(_PARTS), [None] * len(_STATE), [], total[0] + _LETTER_KEYS, total[1])

    return run


def _answer(sent):
    """The words' training counts, their numbers of pairs, and the log probabilities for each block's pairs of a bucket; the
    bucket's own row comes first."""

    def run(batches):
        all_, states = sent.value
        b = key = count = logp = None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for kind, k, block, *x, base, kept in zip(*[batch.column(c).to_pylist() for c in ("kind", "bucket", "block", *_PARTS, "base", "kept")], strict=True):
                if kind < 0:
                    b = Bucket(k, x)
                    key, count = (b.word << 16) | b.context, b.by_word(b.count).astype(np.int64)
                    kept = [unpack(v, np.int64) for v in kept]
                    p = b.probabilities(unpack(base, np.float64), list(zip(kept[::2], kept[1::2], strict=True)), states, all_)
                    logp = np.clip(np.round(-np.log10(np.maximum(p, 1e-32)) / STEP), 0, 65535).astype(np.uint16)
                    continue
                at = np.searchsorted(b.hash, unpack(x[0], np.uint64))
                asked = (np.repeat(at, unpack(x[1], np.uint32)) << 16) | unpack(x[4], np.uint16)
                for col, v in zip(out, (block, k, pack(count[at]), pack(logp[np.searchsorted(key, asked)]), x[1]), strict=True):
                    col.append(v)
            if out[0]:
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["block", "bucket", "a", "b", "c"])

    return run


def _score(tokens: int, types: int):
    def run(batches):
        block, held, base, logp, known = None, [], None, None, None
        for batch in batches:
            for b, kind, a, c, times, docs in zip(*[batch.column(n).to_pylist() for n in ("block", "kind", "a", "b", "c", "d")], strict=True):
                if b != block:
                    block, held, base = b, [], None
                if kind == 0:
                    held.append((a, c, times))
                    continue
                if base is None:
                    n = np.concatenate([np.repeat(unpack(x[0], np.int64), unpack(x[2], np.uint32)) for x in held])
                    logp = np.concatenate([unpack(x[1], np.uint16) for x in held]) * -STEP
                    base, known = np.log10((n + 1) / (tokens + types + 1)), n > 0
                step = unpack(a, np.uint16).astype(np.int64) | (unpack(c, np.uint16).astype(np.int64) << 16)
                times = unpack(times, np.uint32).astype(np.int64)
                ids, flags, size = unpack(docs, np.int64).reshape(3, -1)
                doc = np.repeat(np.arange(len(ids)), size)
                # steps start anew with every text
                heads = np.cumsum(size) - size
                upto = np.cumsum(step)
                w = upto - (upto[heads] - step[heads])[doc]
                total = lambda x: np.bincount(doc, x, len(ids))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=(flags & 2) > 0), pa.array((flags & 1) > 0), pa.array(total(times).astype(np.int64)), pa.array(total(times * known[w]).astype(np.int64)), pa.array(total(times * base[w])), pa.array(total(times * logp[w]))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def _totals(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums of what the buckets sent: bounded by the contexts and the alphabet."""
    got = df.select(F.explode(F.arrays_zip("keys", "sums")).alias("x")).groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.sums").alias("n")).orderBy("key").toArrow()
    return got.column("key").to_numpy(), got.column("n").to_numpy()


def score(docs: DataFrame, remainder: int = 2, modulus: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    Trained on the rows whose crc32 of the id isn't `remainder` mod `modulus`. Tokens are the words (runs without
    white space, A-Z in lower case) and one end; a null or empty text is its end alone. score is the model's log10
    probability of the text's tokens, each rounded to STEP, base_score that of smoothed counts. Without training rows
    both come from nothing but the uniform measures. Repeated rows count and are scored each; null ids are rows of
    the id ''; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (document_crc() % modulus == remainder).alias("held_out"))
    survey = written(rows.select("text", "held_out").mapInArrow(tidied(_survey), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).where("kind <> 1 OR n > 1"), "survey")
    tokens, size = (survey.where(f"kind = 2 and key = {k}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for k in (0, 1))
    near = survey.where("kind = 0").select("key", "n").toArrow()
    class_of = ending_classes(near.column("key").to_numpy(), near.column("n").to_numpy())
    often = survey.where(F.col("kind") == 1).where(F.col("n") >= max(2.0, SHARE * tokens)).select("key").toArrow()
    frequent = np.sort(often.column("key").to_numpy().view(np.uint64))
    dropped(survey)
    buckets = max(16, -(-int(size) // BUCKET_BYTES))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 16)
    blocks = written(rows.mapInArrow(tidied(_blocks(buckets, class_of, frequent)), _SCHEMA), "blocks")
    merged = blocks.where("kind = 0").select("bucket", *_PARTS).repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(tidied(_merge), _BUCKET_SCHEMA)
    now = written(merged, "words")
    key, n = _totals(now)
    contexts = len(frequent) + CLASSES + 1

    def vector(lo, size):
        out = np.zeros(size)
        ok = (key >= lo) & (key < lo + size)
        out[key[ok] - lo] = n[ok]
        return out

    def spelling(before, seed):
        letter = key >= _LETTER_KEYS
        return Spelling.seated(key[letter] - _LETTER_KEYS, n[letter], before, seed)

    types, root_customers = vector(_SCALARS, 2)
    customers = vector(0, contexts)
    all_ = Totals(int(customers.sum()), int(types), customers, spelling(Spelling.uniform(), 100))
    state = State(vector(_TABLES, contexts), types, root_customers, *START_AT, root_customers - START_AT[3] * types, 200)
    rng, kept = np.random.default_rng(1), []
    for k in range(SWEEPS):
        sent = spark.sparkContext.broadcast((all_, state))
        swept = written(now.where("bucket is not null").mapInArrow(tidied(_sweep(sent, k >= SWEEPS - KEPT)), _BUCKET_SCHEMA), "sweep")
        dropped(now)
        now = swept
        key, n = _totals(now)
        table_totals, (root_tables, root_customers, apart, root_apart) = vector(_TABLES, contexts), vector(_SCALARS, 4)
        strength, discount = sampled(customers, table_totals, apart, state.strength, state.discount, rng)
        root_strength, root_discount = sampled(np.array([root_customers]), np.array([root_tables]), root_apart, state.root_strength, state.root_discount, rng)
        state = State(table_totals, root_tables, root_customers, strength, discount, root_strength, root_discount, root_customers - root_discount * root_tables, 201 + k)
        all_ = replace(all_, spelling=spelling(all_.spelling, 101 + k))
        kept.append(state)
    sent = spark.sparkContext.broadcast((all_, kept[-KEPT:]))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    tell = now.where("bucket is not null").select("bucket", F.lit(-1).alias("kind"), none("long", "block"), *_PARTS, "base", "kept")
    ask = blocks.where("kind = 0").select("bucket", "kind", "block", "a", "b", none("binary", "c"), none("binary", "d"), "e", none("binary", "f"), none("binary", "base"), none("array<binary>", "kept"))
    answers = tell.unionByName(ask).repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(tidied(_answer(sent)), "block long, bucket int, a binary, b binary, c binary")
    answers = answers.select("block", F.lit(0).alias("kind"), "bucket", "a", "b", "c", none("binary", "d"))
    asking = blocks.where("kind = 1").select("block", "kind", "bucket", "a", "b", "c", "d")
    scored = answers.unionByName(asking).repartition("block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(
        tidied(_score(all_.tokens, all_.types)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.withColumn("train_tokens", F.lit(all_.tokens).cast("long"))
