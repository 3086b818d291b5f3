"""Source divergence audit: how far the sources of a language are from one another, and by which terms, counted by DuckDB in shards.

1. Counts. Each task lets DuckDB find and count the terms of its texts; what it hands on is one row for each language, source and
   term. Rows are hashed by language and term to shards, and each shard adds up its rows and keeps the terms that are in at
   least `least` documents of their language.
2. Totals. Spark adds up what each group and each language holds.
3. Partial sums. Kept counts are hashed by language and term again; each shard sums over the pairs of sources that share a term,
   and ranks its own terms for each group. A source that lacks a term has the same share for all such terms, so these
   sums need no row for it: they follow from how many terms a group has of each count. The number of rows so grows with the
   terms that occur, not with terms times sources.
4. Spark merges sums and rankings.

A shard is sorted by term and language and taken in slices of whole terms, so that DuckDB holds a bounded number of rows. A slice's
rows of one term are at most a few for each task and source. Counts are 64-bit, products 128-bit; nothing is rounded.

Null text, lang and source are empty. A document without terms counts for its group alone. Rows of one doc_id, and repeated ones, are
documents of their own. An empty table gives no rows, a language of one source no pairs; without kept terms all pairs are 0.
Other columns are not read.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, discard, only_columns, portions, trim, written

#: Rows of counts that a task holds before it hands them on, and rows of a slice.
HELD, SLICE = 300_000, 50_000
UNIT = 1_000_000_000
#: The letters that make up a term, everything but ASCII that is no letter.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
COUNT = f"""
WITH d AS (SELECT row_number() OVER () AS id, lang, source, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM batch),
t AS (SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL)
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM t GROUP BY ALL
UNION ALL SELECT DISTINCT lang, source, '', 0, 0 FROM d"""
ADD = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM batch GROUP BY ALL"
#: The row of term '' says that the group occurs.
KEEP = """
WITH c AS (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, sum(docs) AS docs FROM batch GROUP BY ALL)
SELECT lang, source, term, n, CAST(sum(n) OVER w AS BIGINT) AS total, row_number() OVER (w ORDER BY source) = 1 AS head
FROM c WINDOW w AS (PARTITION BY lang, term) QUALIFY term = '' OR sum(docs) OVER w >= {least}"""
SHARE = "(1 + ({unit}::HUGEINT * ({n} + 1)) // ({of} + {v}))"
OFF = "(({p} - {q}) * ({p} - {q})) // {q}"


def _share(n: str, of: str, v: str = "v") -> str:
    return SHARE.format(unit=UNIT, n=n, of=of, v=v)


def _off(p: str, q: str) -> str:
    return OFF.format(p=p, q=q)


#: For each pair of sources: what the terms that both hold add, less what the sums over one of them would count for these.
SHARED = f"""
WITH p AS (SELECT lang, source, term, {_share("n", "own")} AS p, {_share("0", "own")} AS z FROM batch)
SELECT a.lang, a.source, b.source AS item, count(*) AS both, CAST(sum({_off("a.p", "b.p")} - {_off("a.p", "b.z")} - {_off("a.z", "b.p")}) AS DECIMAL(38, 0)) AS amount
FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL"""
TOP = f"""
WITH p AS (SELECT lang, source, term, {_share("n", "own")} AS p, {_share("total", "of_lang")} AS q FROM batch)
SELECT lang, source, term AS item, CAST({_off("p", "q")} AS BIGINT) AS value FROM p WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {_off("p", "q")} DESC, term) <= {{most}}"""


def _engine():
    con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
    con.execute("SET preserve_insertion_order = false")
    return con


def _ask(con, sql: str, batch: pa.Table) -> pa.Table:
    con.register("batch", batch)
    out = con.sql(sql).to_arrow_table()
    con.unregister("batch")
    return out


def _cast(t: pa.Table, schema: pa.Schema):
    return t.cast(schema).to_batches(max_chunksize=65_536)


PART = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("head", pa.bool_())])
SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("both", pa.int64()), ("amount", pa.decimal128(38, 0)), ("value", pa.int64())])


def counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts, one row for each term of a task, or a few; term '' for each group that occurs."""
    docs = only_columns(documents, "lang", "source", "text").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(it):
        con, held, rows = _engine(), [], 0
        for b in it:
            for part in portions(b, "text"):
                held.append(_ask(con, COUNT, pa.Table.from_batches([part])))
                rows += held[-1].num_rows
                if rows > HELD:
                    held = [_ask(con, ADD, pa.concat_tables(held))]
                    rows = held[0].num_rows
                    if rows > HELD // 2:
                        yield from _cast(held[0], PART)
                        held, rows = [], 0
                        trim()
        if held:
            yield from _cast(_ask(con, ADD, pa.concat_tables(held)), PART)
        con.close()
        trim()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def slices(it, most: int = SLICE):
    """Tables of about `most` rows that end where a term ends; rows come sorted by (term, lang)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in it:
        held.append(b)
        rows += b.num_rows
        if rows < most:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = t.slice(t.num_rows - 1)
        same = pc.and_(pc.equal(t["lang"], last["lang"][0]), pc.equal(t["term"], last["term"][0]))
        start = t.num_rows - pc.sum(same).as_py()  # equal rows stand together, at the end
        if start:
            yield t.slice(0, start)
        held, rows = t.slice(start).to_batches(), t.num_rows - start
    if rows:
        yield pa.Table.from_batches(held)


def shards(rows: DataFrame) -> DataFrame:
    return rows.repartition("lang", "term").sortWithinPartitions("term", "lang")  # the first bytes of terms tell more apart than those of langs


def kept(partial: DataFrame, least: int) -> DataFrame:
    """lang, source, term, n, total (of the lang), head (one row of each term): terms in at least `least` documents; term '' for groups."""

    def run(it):
        con = _engine()
        for part in slices(it):
            yield from _cast(_ask(con, KEEP.format(least=least), part), KEPT)
        con.close()
        trim()

    return shards(partial).mapInArrow(run, "lang string, source string, term string, n long, total long, head boolean")


def partial_sums(rows: DataFrame, most: int) -> DataFrame:
    """From (lang, source, term, n, total, own, of_lang, v): of each slice the sums of pairs (both, amount), and its `most` best terms of each group (value)."""

    def run(it):
        con = _engine()
        for part in slices(it):
            for sql in (SHARED, TOP.format(most=most)):
                t = _ask(con, sql, part)
                for c in ("both", "amount", "value"):
                    if c not in t.column_names:
                        t = t.append_column(c, pa.nulls(t.num_rows))
                yield from _cast(t.select(SUMS.names), SUMS)
        con.close()
        trim()

    return shards(rows).mapInArrow(run, "lang string, source string, item string, both long, amount decimal(38,0), value long")


def _plain(p: str, q: str):
    """Exact integer arithmetic in Spark's decimals."""
    return F.expr(f"cast((cast({p} - {q} as decimal(19,0)) * cast({p} - {q} as decimal(19,0))) div {q} as decimal(38,0))")


def _one(n: str, of: str):
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({n} + 1 as decimal(20,0))) div cast({of} + v as decimal(20,0))")


def audit(documents: DataFrame, *, least: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has each other source of the lang, part `term` the group's `most` most telling terms."""
    found = written(kept(counts(documents), least), "term-counts")
    terms = found.filter("term <> ''")
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    vocabulary = terms.filter("head").groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("of_lang"))
    groups = found.filter("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = written(groups.select("lang", "source", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("own", "of_lang", "v")]), "groups")
    sums = written(partial_sums(terms.drop("head").join(bounded(groups), ["lang", "source"]), most), "partial-sums")
    # how many terms of each count a group has, against the groups that lack them
    held = terms.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(bounded(groups.select("lang", "source", "own", "v")), ["lang", "source"])
    other = groups.select("lang", F.col("source").alias("item"), F.col("own").alias("other"))
    met = held.join(bounded(other), "lang").filter("source <> item").withColumns({"p": _one("n", "own"), "z": _one("0", "other")})
    alone = met.groupBy("lang", "source", "item").agg(F.sum("terms").alias("has"), F.sum(F.col("terms") * _plain("p", "z")).alias("lacked"), F.sum(F.col("terms") * _plain("z", "p")).alias("lacking"))
    alone = written(alone.select("lang", "source", "item", "has", F.col("lacked").cast("decimal(38,0)").alias("lacked"), F.col("lacking").cast("decimal(38,0)").alias("lacking")), "alone")
    both = sums.filter("both is not null").groupBy("lang", "source", "item").agg(F.sum("both").alias("both"), F.sum("amount").alias("amount"))
    pairs = groups.join(bounded(other), "lang").filter("source <> item").join(alone, ["lang", "source", "item"], "left")
    back = alone.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("has").alias("has2"), F.col("lacking").alias("lacking2"))
    pairs = pairs.join(back, ["lang", "source", "item"], "left").join(both, ["lang", "source", "item"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(38,0)"))
    neither = F.col("v") - F.coalesce("has", F.lit(0)) - F.coalesce("has2", F.lit(0)) + F.coalesce("both", F.lit(0))
    safe = pairs.withColumn("empty", F.col("v") == 0).withColumn("v", F.greatest("v", F.lit(1)))
    safe = safe.withColumns({"p": _one("0", "own"), "q": _one("0", "other"), "neither": neither})
    value = F.when(F.col("empty"), F.lit(0)).otherwise((F.col("neither") * _plain("p", "q") + zero("lacked") + zero("lacking2") + zero("amount")).cast("long"))
    pairs = safe.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    best = sums.filter("value is not null").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    along = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(along)
    out = written(pairs.withColumn("rank", rank).unionByName(best.withColumn("rank", rank).filter(F.col("rank") <= most)), "divergence")
    discard(found, groups, sums, alone)
    return out
