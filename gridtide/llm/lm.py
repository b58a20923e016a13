"""Scores of texts under a language model learned from the collection.

Method: hierarchical Pitman-Yor model.  A word's context is the word before it;
every such word has a restaurant of its own, and all context restaurants share
one parent, whose base is uniform over the vocabulary and one unknown
word.  Customers are the training tokens; the tables of a context restaurant
are the customers of the parent.  Seating approximates Gibbs sweeps: in
every sweep the customers of a word in a restaurant leave and are seated again
one after another by the Chinese restaurant rule, each seeing only those before
it, all else as it is, and only the number of tables is kept; beyond ``SINGLY``
customers they come in groups of a sixteenth, within which the rule's
probability is held.  The draws are not corrected towards the exact conditional.
A token's probability is the mean over several samples.

All of it is spread by word: a bucket of words has the words' counts in all
contexts, and of the rest of the model only the totals of its contexts'
restaurants matter.  Between rounds they are summed up by parts of the contexts
and go back to the buckets that asked, as a frame, each bucket's seating with them; the driver sees a few sums
over all.  Within a round a bucket corrects them by its own changes.  Texts are
cut into blocks by ranges of their id.  A block asks for the distinct (context,
word) pairs it holds, with their counts, and gets their probabilities back in
order, so what moves is a dictionary for each block, not a row for each token.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.components import stored, stored_by
from gridtide.llm.words import SPACED, Words, give_back, mix, text_chunks

#: Values of the bits of a context that a key holds; with the other ones, kept beside the key, they are 52 bits of its hash.
CONTEXTS = 4096
_REST = np.uint64(24)
_LOW = np.uint64(CONTEXTS.bit_length() - 1)
#: Discounts and strengths of the context restaurants and of their parent.
DISCOUNT, STRENGTH = 0.8, 200.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.8, 10.0
#: Rounds between which totals are summed up, sweeps in a round, and sweeps of the last round that count as samples.
ROUNDS, SWEEPS, SAMPLES = 3, 2, 3
SINGLY = 64
#: Bytes of text in a block, about, and tokens of one part of the input packed at once.
BLOCK_BYTES = 12_000_000
#: Bytes of text for each part of the contexts, about; however many buckets there are, each has one message for a part.
PART_BYTES = 32_000_000
FLUSH = 1 << 20

_WORD = np.uint64((1 << 64) - CONTEXTS)
_END = mix(np.array([0x5EED], dtype=np.uint64))[0]
_START = np.uint64(0)


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their bytes of equal weight together, which packs well when the high ones are zero."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplaned(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def _gaps(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x[:1], np.diff(x)))


def pair_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, rest) of every token of some texts, the end of each text included, in order.

    A key is the first 52 bits of the word's hash, and the last 12 of its
    context's; ``rest`` has the first 40 of the context's.
    """
    words = Words(column, SPACED)
    n = len(words.counts)
    text = np.repeat(np.arange(n), words.counts + 1)
    word = np.full(len(text), _END, dtype=np.uint64)  # each text's words, then its end
    word[np.arange(len(words.text)) + words.text] = words.hashes()
    before = np.concatenate((np.zeros(1, np.uint64), word[:-1]))
    before[np.concatenate(([True], text[1:] != text[:-1]))] = _START
    context = mix(before)
    return text, (word & _WORD) | (context & np.uint64(CONTEXTS - 1)), context >> _REST


def _order(key: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Places of the pairs in ascending order; equal pairs in any."""
    order = np.argsort(key)
    k, r = key[order], rest[order]
    same = k[1:] == k[:-1]
    unlike = same & (r[1:] != r[:-1])
    if unlike.any():  # few keys have several rests
        run = np.concatenate(([0], np.cumsum(~same)))
        mixed = np.zeros(run[-1] + 1, dtype=bool)
        mixed[run[1:][unlike]] = True
        at = np.flatnonzero(mixed[run])
        order[at] = order[at][np.lexsort((r[at], k[at]))]
    return order


def _fresh(key: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Where sorted pairs differ from the one before."""
    return np.concatenate(([True], (key[1:] != key[:-1]) | (rest[1:] != rest[:-1])))


def _asked(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, keys, rests, counts): each block's pairs and their training counts, by buckets of words."""

    def packed(parts: list) -> Iterator[pa.RecordBatch]:
        block, key, rest, learn = (np.concatenate(x) for x in zip(*parts, strict=True))
        rows: dict[str, list] = {"bucket": [], "block": [], "keys": [], "rests": [], "counts": []}
        for one in np.unique(block):
            mine = block == one
            order = _order(key[mine], rest[mine])
            k, r, c = key[mine][order], rest[mine][order], learn[mine][order].astype(np.int64)
            begin = np.flatnonzero(_fresh(k, r))
            k, r, c = k[begin], r[begin], np.add.reduceat(c, begin).astype(np.uint32)
            bucket = ((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            for x, y in zip(edge, np.append(edge[1:], len(k)), strict=True):
                rows["bucket"].append(int(bucket[x]))
                rows["block"].append(int(one))
                rows["keys"].append(_planes(_gaps(k[x:y])))
                rows["rests"].append(_planes(r[x:y]))
                rows["counts"].append(_planes(c[x:y]))
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("rests", pa.binary()), ("counts", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for a, b in text_chunks(batch["text"]):
                part = batch.slice(a, b - a)
                text, key, rest = pair_keys(part["text"])
                parts.append((part["block"].to_numpy()[text], key, rest, part["learn"].to_numpy(zero_copy_only=False)[text]))
                held += len(key)
                if held >= FLUSH:
                    yield from packed(parts)
                    parts, held = [], 0
                    give_back()
        if parts:
            yield from packed(parts)

    return docs.mapInArrow(run, "bucket int, block int, keys binary, rests binary, counts binary")


def _merged(asked: DataFrame) -> DataFrame:
    """One row a bucket: its distinct pairs with their counts, and who asked for which of them."""

    def run(rows: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unplaned(k.as_py(), np.uint64)) for k in rows["keys"]]
        ends = np.cumsum([len(k) for k in keys])
        key, rest = np.concatenate(keys), np.concatenate([_unplaned(r.as_py(), np.uint64) for r in rows["rests"]])
        counts = np.concatenate([_unplaned(c.as_py(), np.uint32) for c in rows["counts"]])
        del keys
        order = _order(key, rest)
        new = _fresh(key[order], rest[order])
        place = np.empty(len(order), np.uint32)
        place[order] = np.cumsum(new) - 1
        pairs, rests = key[order[new]], rest[order[new]]
        total = np.bincount(place, weights=counts, minlength=len(pairs)).astype(np.uint64)
        del key, rest, counts, order, new
        give_back()
        asked: dict[int, list[np.ndarray]] = {}
        for block, at in zip(rows["block"].to_pylist(), np.split(place, ends[:-1]), strict=True):
            asked.setdefault(block, []).append(at)
        # Each pair once for each block, however many parts of it asked.
        places = [_planes(_gaps(x[0] if len(x) == 1 else np.unique(np.concatenate(x)))) for x in asked.values()]
        one = {"bucket": [rows["bucket"][0].as_py()], "pairs": [_planes(_gaps(pairs))], "rests": [_planes(rests)], "counts": [_planes(total)], "blocks": [list(asked)], "places": [places]}
        kinds = [("bucket", pa.int32()), *((c, pa.binary()) for c in ("pairs", "rests", "counts")), ("blocks", pa.list_(pa.int32())), ("places", pa.list_(pa.binary()))]
        return pa.table(one, schema=pa.schema(kinds))

    return asked.groupBy("bucket").applyInArrow(run, "bucket int, pairs binary, rests binary, counts binary, blocks array<int>, places array<binary>")


class Totals:
    """What a bucket has to know of the rest: customers and tables of its contexts, and words, tables and tokens in all."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, parent_tables: float, words: int, parent_customers: float | None = None) -> None:
        self.customers, self.tables = customers, tables
        self.parent_customers = float(tables.sum()) if parent_customers is None else parent_customers
        self.parent_tables, self.words = parent_tables, words

    def plus(self, tables: np.ndarray, parent_tables: float) -> Totals:
        return Totals(self.customers, self.tables + tables, self.parent_tables + parent_tables, self.words, self.parent_customers + float(tables.sum()))


def seat(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that ``customers`` of a dish take; ``fresh`` is the weight of a new table."""
    tables = (customers > 0).astype(float)
    order = np.argsort(-customers, kind="stable")
    c, a = customers[order], fresh[order]
    t, at, most = tables[order], 1, int(customers.max(initial=0))
    while at < most:
        step = 1 if at < SINGLY else at // 16
        active = int(np.searchsorted(-c, -at, "left"))  # dishes with more than ``at`` customers
        p = a[:active] / (a[:active] + at - discount * t[:active])
        if step == 1:
            t[:active] += rng.random(active) < p
        else:
            t[:active] += rng.binomial(np.minimum(step, c[:active] - at).astype(np.int64), p)
        at += step
    tables[order] = t
    return tables


class Sampler:
    """The seating of one bucket's words, from one table each on through some rounds of given totals."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, history: list[Totals], seed: int, context: np.ndarray | None = None, state: bytes | None = None) -> None:
        """``context`` numbers the pairs' contexts as the totals do; without it the last bits of the pairs are the numbers.

        With ``state`` the seating goes on from there, not from one table each.
        """
        self.context = (pairs & np.uint64(CONTEXTS - 1)).astype(np.int64) if context is None else context
        word = pairs & _WORD
        new = np.concatenate(([True], word[1:] != word[:-1]))
        self.word = np.cumsum(new) - 1
        self.begin = np.flatnonzero(new)
        self.counts = counts.astype(np.int64)
        self.several = np.flatnonzero(self.counts > 1)  # all others have a table for each customer
        self.rng = np.random.default_rng(seed)
        self.tables = np.minimum(self.counts, 1).astype(float)
        if state is not None:
            tables, parent_tables, self.rng.bit_generator.state = pickle.loads(state)
            self.tables[self.several] = _unplaned(tables, np.uint64)
        self.parent = np.add.reduceat(self.tables, self.begin)
        self.parent_tables = np.minimum(self.parent, 1) if state is None else _unplaned(parent_tables, np.uint64).astype(float)
        self.word_counts = np.add.reduceat(self.counts, self.begin)
        for k, totals in enumerate(history):
            self.contexts = len(totals.tables)
            self.elsewhere = totals.plus(-self.own_tables(), -self.parent_tables.sum())
            self.totals = totals
            for _ in range(SWEEPS if k < len(history) - 1 else 0):
                self.sweep()

    def state(self) -> bytes:
        """All that the next round needs to go on: tables of several customers, the parent's, and the generator."""
        tables = (_planes(x.astype(np.uint64)) for x in (self.tables[self.several], self.parent_tables))
        return pickle.dumps((*tables, self.rng.bit_generator.state))

    def own_tables(self) -> np.ndarray:
        return np.bincount(self.context, weights=self.tables, minlength=self.contexts)

    def base(self) -> np.ndarray:
        """Each word's probability in the parent."""
        t = self.totals
        rest = (PARENT_STRENGTH + PARENT_DISCOUNT * t.parent_tables) / (t.words + 1)
        return (self.parent - PARENT_DISCOUNT * self.parent_tables + rest) / (PARENT_STRENGTH + t.parent_customers)

    def sweep(self) -> None:
        t = self.totals
        at = self.several
        fresh = (STRENGTH + DISCOUNT * t.tables[self.context[at]]) * self.base()[self.word[at]]
        self.tables[at] = seat(self.counts[at], fresh, DISCOUNT, self.rng)
        self.parent = np.add.reduceat(self.tables, self.begin)
        rest = (PARENT_STRENGTH + PARENT_DISCOUNT * t.parent_tables) / (t.words + 1)
        self.parent_tables = seat(self.parent.astype(np.int64), np.full(len(self.parent), rest), PARENT_DISCOUNT, self.rng)
        self.totals = self.elsewhere.plus(self.own_tables(), self.parent_tables.sum())

    def probability(self) -> np.ndarray:
        """Each pair's probability of the word in its context."""
        t = self.totals
        own = self.counts - DISCOUNT * self.tables
        back = (STRENGTH + DISCOUNT * t.tables[self.context]) * self.base()[self.word]
        return (own + back) / (STRENGTH + t.customers[self.context])


class Bucket:
    """One bucket's pairs, their contexts numbered, and the seating that the round before left."""

    def __init__(self, row: dict, told: list[dict], sums: dict | None) -> None:
        self.pairs, self.counts = np.cumsum(_unplaned(row["pairs"], np.uint64)), _unplaned(row["counts"], np.uint64)
        whole = (_unplaned(row["rests"], np.uint64) << _LOW) | (self.pairs & np.uint64(CONTEXTS - 1))
        self.contexts, context = np.unique(whole, return_inverse=True)
        history, state = [], None
        if sums is not None:
            mine = sorted((t for t in told if t["state"] is None), key=lambda t: t["part"])
            state = next((t["state"] for t in told if t["state"] is not None), None)
            joined = lambda c: np.concatenate([_unplaned(t[c], np.uint64) for t in mine]).astype(float)
            history = [Totals(joined("customers"), joined("tables"), sums["parent_tables"], sums["words"], float(sums["tables"]))]
        self.seating = Sampler(self.pairs, self.counts, history, row["bucket"], context, state)

    def by_context(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.seating.context, weights=weights, minlength=len(self.contexts)).astype(np.uint64)


_TOLD = "bucket int, part int, customers binary, tables binary, n_customers long, n_tables long, words long, parent_tables long, state binary"


def _with_told(rows: DataFrame, told: DataFrame | None, f, schema: str) -> DataFrame:
    """``f`` of each bucket's row and what it was told in the round before."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from f(row, []).to_batches()

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([f(row, right.to_pylist()) for row in left.to_pylist()])

    if told is None:
        return rows.mapInArrow(alone, schema)
    told = told.select("bucket", "part", "customers", "tables", "state")
    return rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(both, schema)


def _counted(merged: DataFrame, told: DataFrame | None, sums: dict | None, parts: int) -> tuple[DataFrame, dict]:
    """What each bucket is told of its contexts after one more round, and the sums over all; at first of one table for each pair and word.

    A bucket's seating goes along, so that no round repeats those before it.
    """
    own = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("contexts", "customers", "tables")), ("words", pa.int64()), ("parent_tables", pa.int64()), ("state", pa.binary())])
    back = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("customers", pa.binary()), ("tables", pa.binary()), *((c, pa.int64()) for c in ("n_customers", "n_tables", "words", "parent_tables")), ("state", pa.binary())])

    def asked(row: dict, heard: list[dict]) -> pa.Table:
        b = Bucket(row, heard, sums)
        s = b.seating
        for _ in range(SWEEPS if sums is not None else 0):
            s.sweep()
        customers, tables = b.by_context(s.counts), b.by_context(s.tables)
        part = ((b.contexts >> np.uint64(20)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        rows = []
        for x, y in zip(edge, np.append(edge[1:], len(part)), strict=True):
            first = int(x == 0)
            rows.append({
                "part": int(part[x]), "bucket": row["bucket"], "contexts": _planes(_gaps(b.contexts[x:y])), "customers": _planes(customers[x:y]), "tables": _planes(tables[x:y]),
                "words": first * int((s.word_counts > 0).sum()), "parent_tables": first * int(s.parent_tables.sum()),
            })
        if sums is not None:
            rows.append({"part": -1 - row["bucket"], "bucket": row["bucket"], "words": 0, "parent_tables": 0, "state": s.state()})
        return pa.Table.from_pylist(rows, schema=own)

    def added(rows: pa.Table) -> pa.Table:
        if rows["part"][0].as_py() < 0:  # a bucket's own seating
            return pa.Table.from_pylist([{**r, "n_customers": 0, "n_tables": 0} for r in rows.drop_columns(["contexts"]).to_pylist()], schema=back)
        contexts = [np.cumsum(_unplaned(c.as_py(), np.uint64)) for c in rows["contexts"]]
        ends = np.cumsum([len(c) for c in contexts])[:-1]
        place = np.unique(np.concatenate(contexts), return_inverse=True)[1]
        out = {"bucket": rows["bucket"], "part": rows["part"], "words": rows["words"], "parent_tables": rows["parent_tables"], "state": rows["state"]}
        for c in ("customers", "tables"):
            total = np.bincount(place, weights=np.concatenate([_unplaned(x.as_py(), np.uint64) for x in rows[c]])).astype(np.uint64)
            out[c] = pa.array([_planes(x) for x in np.split(total[place], ends)], pa.binary())
            out[f"n_{c}"] = pa.array([int(total.sum()), *[0] * (rows.num_rows - 1)], pa.int64())
        return pa.table([out[n] for n in back.names], schema=back)

    schema = "part int, bucket int, contexts binary, customers binary, tables binary, words long, parent_tables long, state binary"
    sent = _with_told(merged.select("bucket", "pairs", "rests", "counts"), told, asked, schema)
    heard = stored(sent.groupBy("part").applyInArrow(added, _TOLD), "totals")
    one = heard.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("n_customers", "tokens"), ("n_tables", "tables"), ("words", "words"), ("parent_tables", "parent_tables"))))
    return heard, one.first().asDict()


def _answered(merged: DataFrame, told: DataFrame, sums: dict) -> DataFrame:
    """(block, bucket, scores, counts): for each block log10 of its pairs' mean probability, and the words' counts, in the order of the pairs."""
    kinds = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("scores", pa.binary()), ("counts", pa.binary())])

    def run(row: dict, heard: list[dict]) -> pa.Table:
        b = Bucket(row, heard, sums)
        s = b.seating
        mean = np.zeros(len(b.pairs))
        for k in range(SWEEPS + SAMPLES - 1):
            s.sweep()
            if k >= SWEEPS - 1:
                mean += s.probability() / SAMPLES
        scores = np.log10(np.minimum(mean, 1.0)).astype(np.float32)
        words = s.word_counts[s.word].astype(np.uint64)
        del b, s, mean
        give_back()
        places = [np.cumsum(_unplaned(raw, np.uint32)) for raw in row["places"]]
        n = len(places)
        return pa.table([row["blocks"], [row["bucket"]] * n, [_planes(scores[at]) for at in places], [_planes(words[at]) for at in places]], schema=kinds)

    return _with_told(merged, told, run, "block int, bucket int, scores binary, counts binary")


def _scored(docs: DataFrame, answers: DataFrame, sums: dict) -> DataFrame:
    """The documents with the sums over their tokens."""
    tokens, words = sums["tokens"], sums["words"]
    kinds = [("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (right.num_rows and left.num_rows):
            return pa.table({n: pa.array([], k) for n, k in kinds})
        left = left.combine_chunks()
        texts, ids = left["text"].chunk(0), left["id"].chunk(0)
        parts = []
        for a, b in text_chunks(texts):
            text, key, rest = pair_keys(texts.slice(a, b - a))
            parts.append(((text + a).astype(np.int32), key, rest))
        text, key, rest = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        # The answers, bucket after bucket, are those to the block's distinct pairs in order.
        order = _order(key, rest)
        place = np.cumsum(_fresh(key[order], rest[order])) - 1
        text = text[order]
        del key, rest, order
        give_back()
        right = right.sort_by("bucket")
        scores = np.concatenate([_unplaned(s.as_py(), np.float32) for s in right["scores"]])
        counts = np.concatenate([_unplaned(c.as_py(), np.uint64) for c in right["counts"]])
        if len(scores) != place[-1] + 1:
            raise ValueError(f"{len(scores)} answers to {place[-1] + 1} pairs of a block")
        total = lambda w: np.bincount(text, weights=w[place], minlength=len(ids))
        n = np.bincount(text, minlength=len(ids))
        base = total(np.log10(counts + 1.0)) - n * np.log10(tokens + words + 1.0)
        columns = [ids, n, total((counts > 0).astype(float)).astype(np.int64), base, total(scores.astype(float))]
        return pa.table([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], schema=pa.schema(kinds))

    schema = "id long, n_tokens long, n_known long, base_score double, score double"
    return docs.select("block", "id", "text").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def score_texts(df: DataFrame, learn: str, document: str = "doc_id", column: str = "text") -> DataFrame:
    """(document, n_tokens, n_known, train_tokens, base_score, score) of every row of ``df``.

    The model learns from the rows in which the boolean column ``learn`` is true
    (null is false) and scores all.  Tokens are the words of the whole text,
    lower-cased in A-Z, and one end.  ``n_known`` counts tokens met in training,
    ``train_tokens`` is the number of training tokens, ``base_score`` the log10
    probability under add-one counts, ``score`` the one under the model.  Null
    and empty texts consist of their end.  Ids have to be long and may be null
    or repeated; every row gets its result.  Without rows to learn from all
    words are unknown; an empty table gives no rows.  Other columns are not read.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(document).cast("long").alias("id"), F.coalesce(column, F.lit("")).alias("text"), F.coalesce(F.col(learn), F.lit(False)).alias("learn"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    cuts = docs.agg(F.percentile_approx("id", [k / blocks for k in range(1, blocks)] or [0.5], 100 * blocks)).first()[0]
    cuts = sorted(set(cuts or []))
    block = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    docs = docs.withColumn("block", F.when(F.col("id").isNull(), F.lit(0)).otherwise(block).cast("int"))
    # Every round meets the pairs where they lie; only what buckets are told is exchanged.
    merged = stored_by(_merged(_asked(docs, 8 * partitions)), "counts", "bucket", 2 * partitions)
    told = sums = None
    for _ in range(ROUNDS):
        told, sums = _counted(merged, told, sums, size // PART_BYTES + 1)
    scored = _scored(docs, _answered(merged, told, sums), sums)
    return scored.select(F.col("id").alias(document), "n_tokens", "n_known", F.lit(sums["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """One row, (perplexity): of all texts in ``scored`` together; null for an empty table."""
    return scored.select(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))
