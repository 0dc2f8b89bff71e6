"""Language-model scores from a hierarchical Pitman-Yor model.

Restaurants: one for each context, all with the same parent, the unigram restaurant, whose
base is diffuse (every word it serves has one table there; the probability of a new table is
that of a word never seen). The context of a token is the word before it, or the start of the text:
every word has a restaurant of its own. Those of the most frequent words (``named``, a parameter) are
kept as vectors that every task has; that only decides which way a context takes. With ``named=0`` no word is
a context, but its ending (the last three bytes, hashed to a fixed number of restaurants).

    P(w | u) = (c_uw - d t_uw) / (theta + c_u) + (theta + d t_u) / (theta + c_u) * P(w)
    P(w)     = (t_.w - d') / (theta' + t_..),     P(unseen) = (theta' + d' V) / (theta' + t_..)

The tables t_uw come from Gibbs sweeps: the customers of one word in one context are taken out
and seated again one by one, given all others; the predictive probabilities of the samples after
burn-in are averaged. Discounts are estimated from the counts of counts over the whole corpus.

The corpus is dealt by word. A head of the most frequent words (a parameter) in named contexts is counted and
sampled as one small matrix and scored in the scan; it only decides which way a word takes.
All occurrences of every other word meet in one bucket, once, as packed arrays; words of the head behind other
words are dealt by the word before. There they
are counted, seated and scored, and sums per document go back. Buckets hold about a million
tokens of the corpus at any size, and a word that is frequent enough to be hot is in the head.
Customers and tables of a context that is not named are added up over the buckets in two exchanges: each bucket asks for
the contexts that it meets, dealt by their hash, and gets their sums back.
Each bucket is sampled once, its samples are written. While a bucket samples, it takes the tables of the other buckets to have grown as its own; the
probabilities use the true sums over all buckets."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.llm import textkit as K
from kontor.llm.frames import fold, id_and_text, landed, small_batches
from kontor.session import checkpoint_dir

U = np.uint64
END = U(0x5BD1E9955BD1E995)             # the token that ends every text
NAMED, ENDINGS, HEAD, BUCKET_TOKENS, LEAST_BUCKETS = 992, 32, 2048, 1_000_000, 64
BURN_IN, SAMPLES = 2, 4
THETA, THETA_ROOT = 5.0, 1.0
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
OTHER = 1                                # context of a token: the word before it, by its hash
ONE_BY_ONE = 64                          # customers seated singly; then in groups of a twentieth
HASH_BYTES = (1 << 16) - 1               # hashed at a time: what that takes stays in the processor's cache


@dataclass
class Setting:
    named: int = NAMED                   # words that are contexts themselves
    endings: int = ENDINGS               # restaurants for the start and the endings of other words
    head: int = HEAD
    bucket_tokens: int = BUCKET_TOKENS
    burn_in: int = BURN_IN
    samples: int = SAMPLES

    def __post_init__(self):
        if not (self.endings > 1 and self.contexts <= 1 << 16):
            raise ValueError("contexts: two endings at least, and 65536 restaurants in all at most")

    @property
    def contexts(self) -> int:
        return self.endings + self.named

    @property
    def every(self) -> bool:
        """Words that are not named are contexts too; OTHER stands for them."""
        return self.named > 0


def tokens(data: np.ndarray, offsets: np.ndarray, endings: int, named: np.ndarray,
           every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, context, row) of every token of every row, ends included, in order. ``named``: sorted
    hashes of the words that have a number as contexts. The context of other words is their ending or, with ``every``, OTHER."""
    data = K.LOWER[data]
    start, end, row = K.words(data, offsets)
    rows = len(offsets) - 1
    first = np.searchsorted(row, np.arange(rows + 1))
    n = np.diff(first) + 1
    edge = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
    of = np.repeat(np.arange(rows), n)
    last = np.zeros(len(of), bool)
    last[edge[1:] - 1] = True
    h = np.full(len(of), END)
    word = _hashes(data, start, end)
    h[~last] = word
    ending = OTHER if every else 1 + (_hashes(data, np.maximum(end - 3, start), end) % U(endings - 1)).astype(np.int64)
    own = _place(named, word)
    before = np.zeros(len(of), np.int64)
    lead = np.zeros(len(of), bool)
    lead[edge[:-1]] = True
    before[~lead] = np.where(own >= 0, endings + own, ending)
    return h, before.astype(np.uint16), of


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range; ranges follow one another. The same for any cut into blocks."""
    out = np.empty(len(start), U)
    a = 0
    while a < len(start):
        low = start[a]
        z = max(a + 1, int(np.searchsorted(end, low + HASH_BYTES, side="right")))
        out[a:z] = K.RangeHash(data[low: end[z - 1]])(start[a:z] - low, end[a:z] - low)
        a = z
    return out


def seat(count: np.ndarray, parent: np.ndarray, others: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that ``count`` customers of one dish take, seated one by one in each cell.

    ``parent``: probability of the dish in the parent; ``others``: tables of the other dishes in
    the restaurant. Beyond ONE_BY_ONE customers, groups of a twentieth are seated at a time."""
    order = np.argsort(-count, kind="stable")
    c, p, o = count[order], parent[order], others[order].astype(np.float64)
    t = np.minimum(c, 1).astype(np.int64)
    i = 1
    while True:
        n = int(np.searchsorted(-c, -i, side="left"))          # cells with more than i customers
        if not n:
            break
        step = 1 if i < ONE_BY_ONE else i // 20
        new = (theta + d * (o[:n] + t[:n])) * p[:n]
        chance = np.clip(new / (new + i - d * t[:n]), 0, 1)
        here = np.minimum(step, c[:n] - i)
        t[:n] += (rng.random(n) < chance) if step == 1 else rng.binomial(here, chance)
        i += step
    out = np.empty_like(t)
    out[order] = t
    return out


def discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.05, 0.95))


def sample_tables(cell_word: np.ndarray, cell_context: np.ndarray, count: np.ndarray, words: int, g: dict, rng: np.random.Generator,
                  s: Setting) -> list[np.ndarray]:
    """Tables of each (word, context) cell in each sample. ``g``: least tables per context over
    the whole corpus (``least``), tables known from elsewhere (``known``), discounts, V. Contexts that are
    not named come behind the others, with their least tables (``own``) and those of all such contexts (``others``).
    Words may have tables elsewhere: known ones (``root``) and least ones (``root_least``)."""
    t = np.minimum(count, 1).astype(np.int64)
    n = s.contexts
    own_others = g.get("own", np.zeros(0))
    least_here = np.bincount(cell_context, t, n + len(own_others))
    elsewhere = own_others - least_here[n:]
    known, root = g["known"] or [0.0], g.get("root") or [0.0]
    some = count > 1
    out = []
    for sweep in range(s.burn_in + s.samples):
        here = np.bincount(cell_context, t, n + len(own_others))
        grown = np.where(least_here[:n] > 0, here[:n] / np.maximum(least_here[:n], 1), 1.0)
        growth = here[n:].sum() / max(least_here[n:].sum(), 1) if here[n:].any() else 1.0
        tables = np.concatenate((known[min(sweep, len(known) - 1)] + g["least"] * grown, here[n:] + elsewhere * growth))
        all_tables = tables[:n].sum() + g.get("others", 0) * growth
        at_root = np.bincount(cell_word, t, words) + root[min(sweep, len(root) - 1)] + g.get("root_least", 0.0) * growth
        p = np.maximum(at_root - g["d1"], 1e-3) / (THETA_ROOT + max(all_tables, 1))
        at = cell_context[some]
        t[some] = seat(count[some], p[cell_word[some]], np.maximum(tables[at] - t[some], 0), g["d2"], THETA, rng)
        if sweep >= s.burn_in:
            out.append(t.copy())
    return out


def _root_tables(g: dict, k: int) -> float:
    """Tables of all restaurants in a sample, the customers of the root."""
    return g["all_tables"][k] if "all_tables" in g else g["tables"][k].sum()


def head_probability(cell: np.ndarray, count: np.ndarray, tables: list[np.ndarray], words: int, g: dict, s: Setting) -> np.ndarray:
    """The same for every word of the head in every context; ``cell``: those that occur."""
    word, context = np.divmod(cell, s.contexts)
    total = np.zeros((words, s.contexts))
    for k, t in enumerate(tables):
        r = np.bincount(word, t, words) + (g["root"][k] if "root" in g else 0)
        p = np.where(r > 0, r - g["d1"], THETA_ROOT + g["d1"] * g["V"]) / (THETA_ROOT + _root_tables(g, k))
        total += p[:, None] * ((THETA + g["d2"] * g["tables"][k]) / (THETA + g["customers"]))
        total[word, context] += (count - g["d2"] * t) / (THETA + g["customers"][context])
    return total / len(tables)


def mean_probability(count: np.ndarray, tables: list[np.ndarray], at_root: list[np.ndarray], context: np.ndarray, g: dict) -> np.ndarray:
    """Averaged predictive probability of cells: count in the context, tables there and at the
    root in each sample (0 at the root: an unseen word)."""
    total = np.zeros(len(count))
    for k, (t, r) in enumerate(zip(tables, at_root, strict=True)):
        t_u = g["tables"][k]
        p = np.where(r > 0, r - g["d1"], THETA_ROOT + g["d1"] * g["V"]) / (THETA_ROOT + _root_tables(g, k))
        share = (THETA + g["d2"] * t_u) / (THETA + g["customers"])
        total += np.where(count > 0, count - g["d2"] * t, 0.0) / (THETA + g["customers"][context]) + share[context] * p
    return total / len(tables)


# --- the scans over the texts ---------------------------------------------------------------

def _frequent(s: Setting):
    def run(batches):
        for batch in batches:
            for part in K.pieces(batch):
                h, _, row = tokens(*K.buffer_of(part.column(1)), s.endings, np.empty(0, U), True)
                train = part.column(2).to_numpy(zero_copy_only=False)[row]
                # all tokens for the head; only the training tokens say which words are contexts
                for learnt, some, most in ((False, h, s.head), (True, h[train & (h != END)], s.named)):
                    w, n = np.unique(some, return_counts=True)
                    pick = np.argsort(-n, kind="stable")[:most]          # a piece names as many words as are wanted, at most
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), learnt)), pa.array(w[pick].view(np.int64)), pa.array(n[pick])],
                                                     names=["learnt", "w", "n"])
    return run


@lru_cache(maxsize=4)
def _by_first_bits(head: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of the first 16 bits the place of the first word that has them or more; the words, the last one
    repeated behind them; how many share their first bits at most."""
    words = np.frombuffer(head, U)
    first = np.searchsorted(words, np.arange(1 << 16, dtype=U) << U(48)).astype(np.int32)
    most = int(np.bincount((words >> U(48)).astype(np.int64)).max())
    return first, np.append(words, np.full(most, words[-1])), most


def _place(head: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index in the sorted ``head`` or -1."""
    out = np.full(len(h), -1)
    if not len(head):
        return out
    first, words, most = _by_first_bits(head.tobytes())
    at = first[h >> U(48)]
    for k in range(most):
        hit = words[at + k] == h
        out[hit] = np.minimum(at[hit] + k, len(head) - 1)
    return out


def _other(u: np.ndarray, s: Setting) -> np.ndarray:
    return (u == OTHER) if s.every else np.zeros(len(u), bool)


def _head_counts(head: np.ndarray, named: np.ndarray, s: Setting):
    """Cells of the head and numbered contexts in training texts; cell -1 counts their tokens, -2 all tokens."""
    def run(batches):
        for batch in batches:
            for part in K.pieces(batch):
                h, u, row = tokens(*K.buffer_of(part.column(1)), s.endings, named, s.every)
                train = part.column(2).to_numpy(zero_copy_only=False)[row]
                at = _place(head, h)
                some = (at >= 0) & train & ~_other(u, s)
                cell, n = np.unique(at[some] * s.contexts + u[some].astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(cell, [-1, -2]).astype(np.int32)),
                                                  pa.array(np.append(n, [train.sum(), len(h)]).astype(np.int64))], names=["cell", "n"])
    return run


_PACKED = "bucket int, keys binary, counts binary, train binary, codes binary, words binary, others binary"


def _code_type(head: int, s: Setting) -> type:
    return np.uint16 if s.contexts + head <= 1 << 16 else np.uint32


def _tail(head: np.ndarray, named: np.ndarray, buckets: int, s: Setting):
    """What the matrix of the head leaves, dealt to buckets. A token is a code: its context, or behind those its place in the
    head; ``words`` has the hashes of words that are not in the head, ``others`` those of contexts without a number."""
    def run(batches):
        for batch in batches:
            for part in K.pieces(batch):
                h, u, row = tokens(*K.buffer_of(part.column(1)), s.endings, named, s.every)
                at, other, before = _place(head, h), _other(u, s), np.roll(h, 1)
                keep = (at < 0) | other
                h, u, row, at, other, before = (x[keep] for x in (h, u, row, at, other, before))
                bucket = _dealt(np.where(at < 0, h, before), buckets)
                order = np.lexsort((row, bucket))
                h, u, row, at, other, before, bucket = (x[order] for x in (h, u, row, at, other, before, bucket))
                code = np.where(at < 0, u, s.contexts + at).astype(_code_type(len(head), s))
                new = np.ones(len(h), bool)
                new[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
                first = np.flatnonzero(new)
                counts = np.diff(np.append(first, len(h))).astype(np.uint32)
                keys = part.column(0).to_numpy()[row[first]]
                train = part.column(2).to_numpy(zero_copy_only=False)[row[first]].astype(np.uint8)
                names, tok = np.unique(bucket, return_index=True)
                tok = np.append(tok, len(h))
                doc = np.searchsorted(first, tok)
                edges = [doc, doc, doc, tok] + [np.concatenate((np.zeros(1, np.int64), np.cumsum(x)))[tok] for x in (at < 0, other)]
                cols = [keys, counts, train, code, h[at < 0], before[other]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.astype(np.int32)), *(pa.array([x[a:z].tobytes() for a, z in zip(e[:-1], e[1:], strict=True)], pa.binary())
                                                         for x, e in zip(cols, edges, strict=True))],
                    names=["bucket", "keys", "counts", "train", "codes", "words", "others"])
    return run


def _dealt(h: np.ndarray, n: int) -> np.ndarray:
    """Place of a hash among ``n``, rising with the hash."""
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


_BUCKET = ("bucket int, keys binary, counts binary, cell binary, cell_word binary, cell_context binary, count binary, "
           "heads binary, words int, others binary, totals binary")


def _gather(head: int, s: Setting):
    """All rows of a bucket as one row, its cells numbered: nothing that reads it again can split it."""
    def run(batches):
        parts: dict[int, list[list[bytes]]] = {}
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for i, b in enumerate(cols[0]):
                own = parts.setdefault(b, [[] for _ in range(6)])
                for k in range(6):
                    own[k].append(cols[k + 1][i])
        for b in list(parts):
            own = parts.pop(b)
            keys, counts, train, codes, words, others = (b"".join(own.pop(0)) for _ in range(6))
            code = np.frombuffer(codes, _code_type(head, s))
            of_head = code >= s.contexts
            other = of_head | _other(code, s)
            tail, place = np.unique(np.frombuffer(words, U), return_inverse=True)
            word = np.empty(len(code), np.int64)
            word[~of_head] = place
            heads, place = np.unique(code[of_head].astype(np.int64) - s.contexts, return_inverse=True)
            word[of_head] = len(tail) + place
            contexts, place = np.unique(np.frombuffer(others, U), return_inverse=True)
            context = code.astype(np.int64)
            context[other] = s.contexts + place
            width = s.contexts + len(contexts)
            del own, codes, words, others, code, of_head, other, place
            word *= width
            word += context
            del context
            cells, cell = np.unique(word, return_inverse=True)
            trained = np.repeat(np.frombuffer(train, np.uint8) > 0, np.frombuffer(counts, np.uint32))
            count = np.bincount(cell, trained, len(cells)).astype(np.int64)
            cell_bytes = cell.astype(np.uint32).tobytes()
            del word, cell, trained
            cell_word, cell_context = (x.astype(np.uint32) for x in (cells // width, cells % width))
            del cells
            totals = _facts(Bucket(cell_word, cell_context, count, len(tail), heads, contexts, {}), head, s)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in (
                    keys, counts, cell_bytes, *(x.astype(np.uint32).tobytes() for x in (cell_word, cell_context, count, heads)))),
                 pa.array([len(tail)], pa.int32()), pa.array([contexts.tobytes()], pa.binary()), pa.array([totals.tobytes()], pa.binary())],
                names=[x.split()[0] for x in _BUCKET.split(", ")])
    return run


@dataclass
class Bucket:
    """Cells of a bucket. Words: those dealt to it, then some of the head (``heads``: their places there); contexts: the
    numbered ones, then those of the hashes ``others``."""
    cell_word: np.ndarray
    cell_context: np.ndarray
    count: np.ndarray           # training tokens of each cell
    words: int
    heads: np.ndarray
    others: np.ndarray
    g: dict                     # what is known of the words and contexts of this bucket

    @property
    def all_words(self) -> int:
        return self.words + len(self.heads)

    def per_context(self, values: np.ndarray, s: Setting) -> np.ndarray:
        return np.bincount(self.cell_context, values, s.contexts + len(self.others)).astype(np.int64)

    def per_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.cell_word, values, self.all_words).astype(np.int64)


_CELLS = ["bucket", "cell_word", "cell_context", "count", "heads", "words", "others"]


def _unpack(row: dict, g: dict, s: Setting) -> Bucket:
    word, context, count, heads = (np.frombuffer(row[x], np.uint32).astype(np.int64) for x in ("cell_word", "cell_context", "count", "heads"))
    b = Bucket(word, context, count, row["words"], heads, np.frombuffer(row["others"], U), dict(g))
    if "facts" in row:
        customers, b.g["own"] = _answers(row["facts"], 2, np.uint32)
        b.g["customers"] = np.concatenate((g["customers"], customers))
        zero = np.zeros(b.words)
        b.g["root"] = [np.concatenate((zero, x[heads])) for x in g["root"]]
        here = b.per_word(np.minimum(count, 1))[b.words:]
        b.g["root_least"] = np.concatenate((zero, g["root_least"][heads] - here))
    return b


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _pairs(values: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(values)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(values[at].astype(np.int64))], names=["k", "v"])


def _totals(batches):
    """What adds up over the buckets, as numbered sums."""
    for batch in batches:
        for x in batch.column(0).to_pylist():
            yield _pairs(np.frombuffer(x, np.int64))


def _facts(b: Bucket, head: int, s: Setting) -> np.ndarray:
    """Numbers that add up over the buckets: least tables and customers per numbered context, customers and least tables
    per word of the head, V, cells and words met once and twice, least tables of the other contexts."""
    least = np.minimum(b.count, 1)
    of_head = [np.zeros(head, np.int64) for _ in range(2)]
    for x, values in zip(of_head, (b.count, least), strict=True):
        x[b.heads] = b.per_word(values)[b.words:]
    n = b.per_word(b.count)[:b.words]
    tables = b.per_context(least, s)
    rest = [(n > 0).sum(), (b.count == 1).sum(), (b.count == 2).sum(), (n == 1).sum(), (n == 2).sum(), tables[s.contexts:].sum()]
    return np.concatenate((tables[: s.contexts], b.per_context(b.count, s)[: s.contexts], *of_head, rest)).astype(np.int64)


def _tables(b: Bucket, samples: list[np.ndarray], head: int, s: Setting) -> np.ndarray:
    """For each sample the tables per numbered context and per word of the head, and those of the other contexts."""
    out = []
    for t in samples:
        tables, of_head = b.per_context(t, s), np.zeros(head, np.int64)
        of_head[b.heads] = b.per_word(t)[b.words:]
        out += [tables[: s.contexts], of_head, [tables[s.contexts:].sum()]]
    return np.concatenate(out).astype(np.int64)


_DRAWN = "bucket int, drawn binary, totals binary"


def _draw(g: dict, head: int, s: Setting):
    """The samples of a bucket: tables of its cells with more than one customer, and what adds up over the buckets."""
    def run(batches):
        for row in _rows(batches):
            b = _unpack(row, g, s)
            got = sample_tables(b.cell_word, b.cell_context, b.count, b.all_words, b.g, np.random.default_rng(row["bucket"]), s)
            drawn = np.stack([t[b.count > 1] for t in got]).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["bucket"]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (drawn, _tables(b, got, head, s)))],
                names=["bucket", "drawn", "totals"])
    return run


def _drawn(b: Bucket, row: dict, s: Setting) -> list[np.ndarray]:
    """Tables of every cell in each sample; a cell of one customer has one."""
    out = []
    for tables in np.frombuffer(row["drawn"], np.uint32).reshape(s.samples, -1):
        t = np.minimum(b.count, 1)
        t[b.count > 1] = tables
        out.append(t)
    return out


# --- sums per context without a number, over the buckets --------------------------------------

_ASKED = "bucket int, part int, ids binary, sums binary"


def _ask(values, parts: int, s: Setting):
    """Questions of a bucket: the contexts that it meets, by place of their hash, with its own share of the sums."""
    def run(batches):
        for row in _rows(batches):
            b = _unpack(row, {}, s)
            sums = np.stack([b.per_context(x, s)[s.contexts:] for x in values(b, row)]).astype(np.uint32)
            edge = np.searchsorted(_dealt(b.others, parts), np.arange(parts + 1))
            for i in np.flatnonzero(np.diff(edge)):
                here = slice(edge[i], edge[i + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["bucket"]], pa.int32()), pa.array([i], pa.int32()), pa.array([b.others[here].tobytes()], pa.binary()),
                     pa.array([sums[:, here].tobytes()], pa.binary())], names=["bucket", "part", "ids", "sums"])
    return run


def _add_shares(batches):
    """Each question with the sums of all buckets for its contexts."""
    parts: dict[int, list] = {}
    for batch in batches:
        for bucket, part, ids, sums in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            parts.setdefault(part, []).append((bucket, np.frombuffer(ids, U), np.frombuffer(sums, np.uint32)))
    for part in list(parts):
        own = parts.pop(part)
        at = np.unique(np.concatenate([x[1] for x in own]), return_inverse=True)[1]
        sums = np.concatenate([x[2].reshape(-1, len(x[1])) for x in own], axis=1)
        sums = np.stack([np.bincount(at, x)[at] for x in sums]).astype(np.uint32)
        edge = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x[1]) for x in own])))
        for i, (bucket, _, _) in enumerate(own):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([part], pa.int32()),
                                              pa.array([sums[:, edge[i]: edge[i + 1]].tobytes()], pa.binary())], names=["bucket", "part", "sums"])


def _answers(got: list[dict] | None, n: int, kind: type) -> np.ndarray:
    """The sums of a bucket's contexts, in the order of their hashes."""
    some = [np.frombuffer(x["sums"], kind).reshape(n, -1) for x in sorted(got or [], key=lambda x: x["part"])]
    return np.concatenate(some, axis=1).astype(np.float64) if some else np.zeros((n, 0))


def _dealt_table(df: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """``df`` written in files by bucket, so that joining by bucket moves none of it; and its name."""
    spark = df.sparkSession
    name = f"kontor_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    df.write.bucketBy(buckets, "bucket").format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name), name


def _exchange(asked: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, name): the answers for each bucket."""
    got = asked.repartition(buckets, "part").mapInArrow(_add_shares, "bucket int, part int, sums binary")
    return got.repartition(buckets, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("part", "sums")).alias(name))


def _tail_scores(g: dict, groups: int, s: Setting):
    """Sums per document and bucket, packed by a group of the document's key."""
    def run(batches):
        for row in _rows(batches):
            b = _unpack(row, g, s)
            got = _drawn(b, row, s)
            tables = _answers(row["tables"], s.samples, np.uint32)
            b.g["tables"] = [np.concatenate((a, z)) for a, z in zip(g["tables"], tables, strict=True)]
            at_root = []
            for k, t in enumerate(got):
                r = b.per_word(t)
                r[b.words:] = g["head_root"][k][b.heads]
                at_root.append(r[b.cell_word])
            logp = np.log10(mean_probability(b.count, got, at_root, b.cell_context, b.g))
            # of the words of the head the scan knows all but the probability here
            c = np.where(b.cell_word < b.words, b.per_word(b.count)[b.cell_word], 0)
            keys, counts, cell = (np.frombuffer(row[x], t) for x, t in (("keys", np.int64), ("counts", np.uint32), ("cell", np.uint32)))
            edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)))[:-1]
            sums = [np.add.reduceat(x[cell], edges) for x in (np.log10(c + 1.0), logp, (c > 0).astype(np.int64))]
            group = (keys.view(np.uint64) % U(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            names, at = np.unique(group[order], return_index=True)
            at = np.append(at, len(order))
            cols = [x[order] for x in (keys, sums[0], sums[1], sums[2].astype(np.uint32))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.astype(np.int32)), *(pa.array([x[a:e].tobytes() for a, e in zip(at[:-1], at[1:], strict=True)], pa.binary()) for x in cols)],
                names=["grp", "keys", "base", "score", "known"])
    return run


def _add_up(batches):
    parts: dict[int, list] = {}
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        for i, gr in enumerate(cols[0]):
            parts.setdefault(gr, []).append([np.frombuffer(cols[k + 1][i], t) for k, t in enumerate((np.int64, np.float64, np.float64, np.uint32))])
    for own in parts.values():
        keys, base, score, known = (np.concatenate([p[k] for p in own]) for k in range(4))
        k, at = np.unique(keys, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.bincount(at, base)), pa.array(np.bincount(at, score)),
                                          pa.array(np.bincount(at, known).astype(np.int64))], names=["key", "tail_base", "tail_score", "tail_known"])


def _head_scores(head: np.ndarray, named: np.ndarray, c: np.ndarray, logp: np.ndarray, s: Setting):
    base = np.log10(c + 1.0)

    def run(batches):
        for batch in batches:
            for part in K.pieces(batch):
                rows = part.num_rows
                h, u, row = tokens(*K.buffer_of(part.column(1)), s.endings, named, s.every)
                at = _place(head, h)
                n = np.bincount(row, minlength=rows)
                keep = at >= 0
                at, u, row, here = at[keep], u[keep], row[keep], ~_other(u[keep], s)      # elsewhere: the buckets know
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(3), pa.array(n.astype(np.int64)), pa.array(np.bincount(row, base[at], rows).astype(np.float64)),
                     pa.array(np.bincount(row[here], logp[at[here], u[here]], rows).astype(np.float64)), pa.array(np.bincount(row, c[at] > 0, rows).astype(np.int64))],
                    names=["row_key", "doc_id", "n_tokens", "head_base", "head_score", "head_known"])
    return run


def _summed(df: DataFrame, key: str, value: str, n: int, low: int = 0) -> np.ndarray:
    """Sums by a small integer key, as an array of a size that the parameters fix."""
    got = df.groupBy(key).agg(F.sum(value).alias("v")).toArrow()
    out = np.zeros(n, np.int64)
    out[got.column(key).to_numpy() - low] = got.column("v").to_numpy()
    return out


def score_texts(docs: DataFrame, training: Column | None = None, setting: Setting | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    The model learns from the rows where ``training`` (a condition over doc_id) holds; NULL does not
    hold, no condition means all rows. score: log10 probability of the whole text with its end;
    base_score: add-one unigrams. NULL text counts as empty (one token, the end); repeated
    rows each count and score; NULL ids stay; other columns are ignored; an empty table gives an
    empty table. Without training rows every word is unseen."""
    s = setting or Setting()
    spark = docs.sparkSession
    small_batches(spark)
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")     # what a written table was made from does not stay on disk beside it
    train = F.coalesce(training, F.lit(False)) if training is not None else F.lit(True)
    rows = id_and_text(docs).select(F.xxhash64("doc_id", "text").alias("row_key"), "text", train.alias("train"), "doc_id")
    text = rows.select("row_key", "text", "train")
    words = landed(text.mapInArrow(_frequent(s), "learnt boolean, w long, n long").groupBy("learnt", "w").agg(F.sum("n").alias("n")))

    def most_frequent(learnt: bool, n: int) -> np.ndarray:
        got = words.filter(F.col("learnt") == learnt).orderBy(F.desc("n"), "w").limit(n).toArrow()
        return np.sort(got.column("w").to_numpy().view(np.uint64))

    head, named = most_frequent(False, s.head), most_frequent(True, s.named)
    cells = len(head) * s.contexts
    counts = _summed(text.mapInArrow(_head_counts(head, named, s), "cell int, n long"), "cell", "n", cells + 2, -2)
    all_tokens, train_tokens, c = int(counts[0]), int(counts[1]), counts[2:]
    buckets = max(LEAST_BUCKETS, -(-all_tokens // s.bucket_tokens))
    packed = text.mapInArrow(_tail(head, named, buckets, s), _PACKED).repartition(buckets, "bucket")
    packed, table = _dealt_table(packed.mapInArrow(_gather(len(head), s), _BUCKET), buckets)
    small_batches(spark, 1)             # a row is a bucket
    cells_of = packed.select(*_CELLS)
    n, h = s.contexts, len(head)
    facts = _summed(packed.select("totals").mapInArrow(_totals, "k int, v long"), "k", "v", 2 * n + 2 * h + 6)
    tail_least, tail_customers, more, least_more, rest = np.split(facts, np.cumsum((n, n, h, h)))
    cell = np.flatnonzero(c)
    c = c[cell]
    head_word, head_context = np.divmod(cell, n)
    head_c = np.bincount(head_word, c, h).astype(np.int64) + more
    g = {"d2": discount(rest[1] + (c == 1).sum(), rest[2] + (c == 2).sum()),
         "d1": discount(rest[3] + (head_c == 1).sum(), rest[4] + (head_c == 2).sum()),
         "V": int(rest[0] + (head_c > 0).sum()), "others": int(rest[5]),
         "customers": tail_customers + np.bincount(head_context, c, n)}
    # the head first, given the least tables of the rest; then the rest, given the head
    of_head = sample_tables(head_word, head_context, c, h, g | {
        "least": np.bincount(head_context, c > 0, n), "known": [tail_least.astype(np.float64)], "root": [least_more.astype(np.float64)]},
                            np.random.default_rng(h), s)
    head_tables = [np.bincount(head_context, t, n) for t in of_head]
    head_root = [np.bincount(head_word, t, h) for t in of_head]
    sweeps = [max(0, i - s.burn_in) for i in range(s.burn_in + s.samples)]
    g |= {"least": tail_least.astype(np.float64), "known": [head_tables[i] for i in sweeps],
          "root": [head_root[i] for i in sweeps], "root_least": least_more}
    asked = cells_of.mapInArrow(_ask(lambda b, _: (b.count, np.minimum(b.count, 1)), buckets, s), _ASKED)
    context_facts, facts_table = _dealt_table(_exchange(asked, buckets, "facts"), buckets)
    # every bucket is sampled once; its samples are written
    drawn, drawn_table = _dealt_table(cells_of.join(context_facts.hint("shuffle_hash"), "bucket", "left").mapInArrow(
        _draw(g, h, s), _DRAWN), buckets)
    tables = _summed(drawn.select("totals").mapInArrow(_totals, "k int, v long"), "k", "v", s.samples * (n + h + 1)).reshape(s.samples, -1)
    drawn = drawn.select("bucket", "drawn")
    asked = cells_of.join(drawn.hint("shuffle_hash"), "bucket", "left").mapInArrow(_ask(lambda b, row: _drawn(b, row, s), buckets, s), _ASKED)
    whole = packed.drop("totals").join(context_facts.hint("shuffle_hash"), "bucket", "left").join(
        drawn.hint("shuffle_hash"), "bucket", "left").join(_exchange(asked, buckets, "tables").hint("shuffle_hash"), "bucket", "left")
    more_root = tables[:, n: n + h]
    known = {"tables": [a + b for a, b in zip(head_tables, tables[:, :n], strict=True)]}
    known["all_tables"] = [float(a.sum() + b) for a, b in zip(known["tables"], tables[:, n + h], strict=True)]
    head_logp = np.log10(head_probability(cell, c, of_head, h, g | known | {"root": more_root}, s)).astype(np.float32)
    known["head_root"] = [a + b for a, b in zip(head_root, more_root, strict=True)]
    sums = whole.mapInArrow(_tail_scores(g | known, buckets, s), "grp int, keys binary, base binary, score binary, known binary")
    sums = landed(sums.repartition(buckets, "grp").mapInArrow(
        _add_up, "key long, tail_base double, tail_score double, tail_known long"))
    for name in (table, facts_table, drawn_table):
        spark.sql(f"DROP TABLE {name}")         # the names; the files stay in the shared folder as others do
    spark.conf.set(CLEANUP, kept)
    small_batches(spark)
    kind = rows.schema["doc_id"].dataType.simpleString()
    own = rows.mapInArrow(_head_scores(head, named, head_c, head_logp, s),
                          f"row_key long, doc_id {kind}, n_tokens long, head_base double, head_score double, head_known long")
    # equal rows share a key, and the sums that come back are of all of them
    columns = [c for c in own.columns if c != "row_key"]
    once = own.groupBy("row_key").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in columns))
    joined = once.join(sums, F.col("row_key") == F.col("key"), "left")
    for c in ("tail_base", "tail_score", "tail_known"):
        joined = joined.withColumn(c, F.col(c) / F.col("times"))
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    norm = float(np.log10(train_tokens + g["V"] + 1))
    zero = F.lit(0)
    return joined.select(
        "doc_id", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", zero)).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", zero) - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("head_score") + F.coalesce("tail_score", zero)).alias("score"))


def corpus_scores(docs: DataFrame, setting: Setting | None = None) -> DataFrame:
    """The contract: learn from rows whose crc32(doc_id as text) mod 7 is not 2 and mark the others."""
    out = score_texts(docs, fold("doc_id", 7) != 2, setting)
    return out.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
