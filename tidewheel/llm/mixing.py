"""Mixing to target weights by iterative proportional fitting, with DataFrame operations only.

A document's topic comes from its whole text: the corpus's ``TOPICS`` most widespread words among those found in at most a
``TOPIC_SHARE`` of all documents name the topics, and a document has the topic whose word it holds most often. Tokens are summed
per cell (source, language, topic). Raking multiplies the cells' weights so that each margin meets its
target in turn. A factor is then found in closed form so that the expected tokens of the sample meet the budget while no
probability exceeds 1, and each document is drawn by a hash of its id.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import scope, stored
from .text import SPACE_WORD

DIMS = ("source", "lang", "topic")
#: Cells up to which raking runs in one task and the cells' table is broadcast: some 10 MB of rows.
SMALL_CELLS = 100_000
#: Sweeps between two looks at the margins: of cells in one task, and of more cells.
SWEEPS_A_LOOK, SWEEPS_A_TABLE = 200, 5
#: Raking ends when no margin misses its target by more than this share of all weight, or the miss has shrunk by less than a tenth since the last look.
CLOSE, PROGRESS = 1e-10, 0.9
#: Sweeps that the SQL spells out: more than these tables need to come as close.
SQL_SWEEPS = 1000
#: Topics, and the share of documents (one in so many) above which a word tells nothing of the topic.
TOPICS, TOPIC_SHARE = 6, 10
#: Share of all weight by which a margin may miss its target after raking before a warning is given.
MARGIN_ERROR = 1e-6


def _pieces(text_col: str) -> Column:
    """What stands between blanks and line ends, unchanged: far cheaper than words by a pattern."""
    return F.split(F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")), " ")


def topic_words(docs: DataFrame, text_col: str = "text", topics: int = TOPICS) -> list[str]:
    """The words that name topics: those in most documents, of the words in at most ``1 / TOPIC_SHARE`` of them; ties by name."""
    found = docs.select(F.explode(F.array_distinct(_pieces(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    whole = docs.agg(F.count("*")).first()[0]
    top = found.filter((F.lit(TOPIC_SHARE) * F.col("n") <= whole) & (F.col("word") != "")).orderBy(F.desc("n"), "word").limit(topics)
    return [r.word for r in top.collect()]


def _equals(k: str) -> Callable[[Column], Column]:
    return lambda w: w == F.lit(k)


def with_topic(docs: DataFrame, words: list[str], text_col: str = "text", name: str = "__tw_topic") -> DataFrame:
    """Adds the one of ``words`` that the whole text holds most often, the first of them among equal counts; '' if it has none."""
    if not words:
        return docs.withColumn(name, F.lit(""))
    # A column of its own, which all counts below share: the text is cut once.
    held = docs.withColumn("__tw_held", F.filter(_pieces(text_col), lambda w: w.isin(words)))
    counts = [F.size(F.filter(F.col("__tw_held"), _equals(k))) for k in words]
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    topic = F.when(F.size("__tw_held") == 0, F.lit(""))
    for k, n in zip(words, counts, strict=True):
        topic = topic.when(n == most, F.lit(k))
    return held.withColumn(name, topic).drop("__tw_held")


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(f"({SPACE_WORD})")), F.lit(0)).cast("long")


def draw(id_col: str = "doc_id", seed: int = 1) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _with_sums(cells: DataFrame, keys: list[str], one_task: bool, **sums: Column) -> DataFrame:
    """``cells`` with the aggregates ``sums`` of the rows that share ``keys`` (of all rows without keys)."""
    if one_task:
        return cells.withColumns({k: v.over(Window.partitionBy(*(keys or [F.lit(0)]))) for k, v in sums.items()})
    by = cells.groupBy(*keys).agg(*(v.alias(k) for k, v in sums.items()))
    return cells.join(by, keys) if keys else cells.crossJoin(F.broadcast(by))  # one row


def _swept(cells: DataFrame, sweeps: int) -> DataFrame:
    """``cells`` after some sweeps: one row of arrays, in which each step divides the weights by their margins' sums and multiplies by the targets."""
    rows = F.array_sort(F.collect_list(F.struct(*DIMS, *[c for c in cells.columns if c not in DIMS])))
    one = cells.agg(rows.alias("rows")).withColumn("start", F.transform("rows", lambda r: r["weight"]))
    for d in DIMS:
        one = _margins_of(one, d)
    one = one.select("rows", "start", *(F.array(*(F.col(f"{c}_{d}") for d in DIMS)).alias(c) for c in ("member", "at", "aim")))

    def step(w: Column, i: Column) -> Column:
        d = F.pmod(i, F.lit(len(DIMS)))
        sums = F.transform(F.col("member")[d], lambda some: F.aggregate(some, F.lit(0.0), lambda s, c: s + w[c]))
        # The sums are an array's only element, so that they are computed once.
        return F.transform(
            F.array(sums), lambda m: F.zip_with(w, F.col("at")[d], lambda x, j: F.when(m[j] > 0, x * F.col("aim")[d][j] / m[j]).otherwise(F.lit(0.0)))
        )[0]

    swept = one.select("rows", F.aggregate(F.sequence(F.lit(0), F.lit(len(DIMS) * sweeps - 1)), F.col("start"), step).alias("w"))
    return swept.select(F.explode(F.arrays_zip("rows", "w")).alias("x")).select(*(F.col("x.w").alias(c) if c == "weight" else F.col(f"x.rows.{c}").alias(c) for c in cells.columns))


def _swept_tables(cells: DataFrame, sweeps: int) -> DataFrame:
    """The same over tables, each step an aggregate and a join; a sweep is stored."""
    for _ in range(sweeps):
        for d in DIMS:
            step = F.when(F.col("_margin") > 0, F.col("weight") * F.col(f"t_{d}") / F.col("_margin")).otherwise(F.lit(0.0))
            cells = _with_sums(cells, [d], False, _margin=F.sum("weight")).withColumn("weight", step).drop("_margin")
        cells = stored(cells, "swept")
    return cells


def _margins_of(one: DataFrame, d: str) -> DataFrame:
    """The cells of each value of ``d``, each cell's value by its place, and the values' targets."""
    values = one.withColumn("_v", F.array_distinct(F.transform("rows", lambda r: r[d])))
    placed = values.withColumn(f"at_{d}", F.transform("rows", lambda r: (F.array_position("_v", r[d]) - 1).cast("int")))
    numbers = F.sequence(F.lit(0), F.size("_v") - 1)
    places = F.sequence(F.lit(0), F.size("rows") - 1)
    members = F.transform(numbers, lambda j: F.filter(places, lambda c: F.col(f"at_{d}")[c] == j))
    aims = F.transform(F.col(f"member_{d}"), lambda some: F.col("rows")[some[0]][f"t_{d}"])
    return placed.withColumn(f"member_{d}", members).withColumn(f"aim_{d}", aims).drop("_v")


def _missed(cells: DataFrame) -> float:
    """The most by which a margin misses its target."""
    errors = [cells.groupBy(d).agg(F.abs(F.sum("weight") - F.first(f"t_{d}")).alias("e")) for d in DIMS]
    return max((df.agg(F.max("e")).first()[0] or 0.0) for df in errors)


def rake(
    cells: DataFrame, *, temper: float = 0.5, sweeps: int | None = None, targets: dict[str, dict[str, float]] | None = None,
    one_task: bool = True,
) -> DataFrame:
    """``cells`` (dims and ``tokens`` > 0) with the column ``weight``, which sums to 1, and ``margin_error``, the most by which any margin
    still misses its target.

    A margin's target is ``targets[dim]`` (values left out get 0; scaled to the values there are), or else
    proportional to the margin's tokens to the power ``temper``; that of a topic within each of its languages, as most topics belong to one
    language and could not meet a target apart from it. Sweeps go on until every margin is within ``CLOSE`` of its target, or there is no more
    ``PROGRESS`` (a target that no cell can meet); ``sweeps``, if given, says how many instead. An empty table stays empty. ``one_task``: few cells are raked
    as arrays in one row; more are summed by key and joined to their sums.
    """
    cells, dims = cells.coalesce(1) if one_task else cells, list(DIMS)
    for d in dims:
        if d == "topic" and not (targets and d in targets):
            # A topic's target is made of shares of its languages' targets, so both margins can be met at once.
            part = F.pow(F.col("_tokens").cast("double"), F.lit(temper))
            cells = _with_sums(cells, ["lang", "topic"], one_task, _tokens=F.sum("tokens"), _cells=F.count("*")).withColumn("_part", part / F.col("_cells"))
            cells = _with_sums(cells, ["lang"], one_task, _whole=F.sum("_part")).withColumn("_part", F.col("t_lang") * F.col("_part") / F.col("_whole"))
            cells = _with_sums(cells, ["topic"], one_task, t_topic=F.sum("_part")).drop("_tokens", "_cells", "_part", "_whole")
            continue
        if targets and d in targets:
            given = F.create_map(*[F.lit(x) for kv in targets[d].items() for x in kv])
            target = F.coalesce(F.try_element_at(given, F.col(d)).cast("double"), F.lit(0.0))
        else:
            target = F.pow(F.col("_tokens").cast("double"), F.lit(temper))
        cells = _with_sums(cells, [d], one_task, _tokens=F.sum("tokens"), _cells=F.count("*")).withColumn(f"t_{d}", target)
        cells = _with_sums(cells, [], one_task, _whole=F.sum(F.col(f"t_{d}") / F.col("_cells")))
        cells = cells.withColumn(f"t_{d}", F.col(f"t_{d}") / F.col("_whole")).drop("_tokens", "_cells", "_whole")
    cells = _with_sums(cells, [], one_task, _whole=F.sum("tokens")).withColumn("weight", F.col("tokens") / F.col("_whole")).drop("_whole")
    look, missed = sweeps or (SWEEPS_A_LOOK if one_task else SWEEPS_A_TABLE), None
    cells = stored(cells, "unraked")
    while not cells.isEmpty():
        cells = stored(_swept(cells, look) if one_task else _swept_tables(cells, look), "raked")
        before, missed = missed, _missed(cells)
        if sweeps or missed <= CLOSE or before is not None and missed > PROGRESS * before:
            break
    cells = cells.coalesce(1) if one_task else cells
    cells = _with_sums(cells, [], one_task, _whole=F.sum("weight")).withColumn("weight", F.col("weight") / F.col("_whole")).drop("_whole")
    cells = cells.withColumn("margin_error", F.lit(0.0))
    for d in dims:
        missed = F.greatest("margin_error", F.abs(F.col("_margin") - F.col(f"t_{d}")))
        cells = _with_sums(cells, [d], one_task, _margin=F.sum("weight")).withColumn("margin_error", missed).drop("_margin")
    cells = _with_sums(cells, [], one_task, _worst=F.max("margin_error")).withColumn("margin_error", F.col("_worst")).drop("_worst")
    return cells.drop(*(f"t_{d}" for d in DIMS))


def probabilities(cells: DataFrame, fraction: float, one_task: bool = True) -> DataFrame:
    """Raked ``cells`` with ``probability`` = min(1, factor * weight / tokens), whose expected tokens are ``fraction`` of all.

    If the cells that the factor would fill are c1..ck in order of tokens / weight, the factor is
    (budget - their tokens) / (the others' weight). Every other k gives a smaller value, so it is the largest. Many cells are
    sorted in ranges, each of which starts from the sums of the ranges before it.
    """
    live = F.when(F.col("weight") > 0, F.col("tokens")).otherwise(F.lit(0))
    ratio = F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight")).otherwise(F.lit(float("inf")))
    known = cells.withColumns({"ratio": ratio, "live": live, "part": F.lit(0)})
    # At equal ratios any order gives the same largest value.
    if not one_task:
        known = stored(known.repartitionByRange("ratio", *DIMS).withColumn("part", F.spark_partition_id()), "ranges")
    ends = known.groupBy("part").agg(F.sum("live").alias("l"), F.sum("weight").alias("w"), F.sum("tokens").alias("t")).orderBy("part").collect()  # one a range
    every, heavy, live_before, weight_after = sum(r.t for r in ends), sum(r.w for r in ends), {}, {}
    total, left = 0, heavy
    for r in ends:
        live_before[r.part], weight_after[r.part] = total, left - r.w
        total, left = total + r.l, left - r.w
    order = Window.partitionBy("part").orderBy("ratio", *DIMS)

    def of_part(values: dict) -> Column:
        return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("part")] if values else F.lit(0)

    before = F.sum("live").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("live")
    after = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    if not one_task:
        before, after = before + of_part(live_before), after + of_part(weight_after)
    known = known.withColumn("factor", F.when(F.col("weight") > 0, (F.lit(every * fraction) - before) / after))
    known = _with_sums(known, [], one_task, _factor=F.max("factor"))
    factor = F.greatest(F.coalesce("_factor", F.lit(0.0)), F.lit(0.0))
    drawn = known.withColumn("probability", F.least(F.lit(1.0), factor * F.col("weight") / F.col("tokens")))
    return drawn.drop("ratio", "live", "part", "factor", "_factor")


def mix(
    docs: DataFrame, *, fraction: float = 0.5, temper: float = 0.5, seed: int = 1, sweeps: int | None = None,
    targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, small_cells: int = SMALL_CELLS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
) -> tuple[DataFrame, DataFrame]:
    """``(cells, drawn)``: the raked cells, and every row of ``docs`` with the columns ``__tw_source``, ``__tw_lang``,
    ``__tw_topic``, ``__tw_tokens``, ``__tw_weight`` (of its cell), ``__tw_probability`` and ``__tw_sampled``.

    Tokens are words (cut at U+0020 and U+0009-U+000D). A null source, language or topic is the value ''. A cell without words has
    weight and probability 0, so its documents are not sampled. Repeated rows share one draw, as do all rows with a null id.
    ``topic`` defaults to ``with_topic`` over the whole texts; a long text is one row. An empty table gives empty results. Where sparse cells keep a margin from
    its target, ``margin_error`` of the cells says by how much, and above ``MARGIN_ERROR`` there is a warning.
    """
    told = with_topic(docs, topic_words(docs, text_col), text_col) if topic is None else docs.withColumn("__tw_topic", F.coalesce(topic, F.lit("")))
    marked = told.withColumns(
        {
            "__tw_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
            "__tw_lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")), "__tw_tokens": word_count(text_col),
        }
    )
    with scope():
        cells = marked.groupBy(*(F.col(f"__tw_{d}").alias(d) for d in DIMS)).agg(F.sum("__tw_tokens").alias("tokens"), F.count("*").alias("docs"))
        cells = stored(cells.filter("tokens > 0"), "cells")
        small = cells.count() <= small_cells
        raked = rake(cells, temper=temper, sweeps=sweeps, targets=targets, one_task=small)
        raked = stored(probabilities(stored(raked, "weights"), fraction, small), "probabilities", keep=True)
        missed = raked.agg(F.max("margin_error")).first()[0]
        if missed is not None and missed > MARGIN_ERROR:
            warnings.warn(f"a margin misses its target by {missed:.3g} of all weight", stacklevel=2)
    side = raked.select(*(F.col(d).alias(f"__tw_{d}") for d in DIMS), F.col("weight").alias("__tw_weight"), F.col("probability").alias("__tw_probability"))
    drawn = marked.join(F.broadcast(side) if small else side, [f"__tw_{d}" for d in DIMS], "left").na.fill(
        0.0, ["__tw_weight", "__tw_probability"]
    )
    return raked, drawn.withColumn("__tw_sampled", draw(id_col, seed) < F.col("__tw_probability"))


def oracle(fraction: float = 0.5, temper: float = 0.5, seed: int = 1, sweeps: int = SQL_SWEEPS, topics: int = TOPICS) -> str:
    """DuckDB SQL of the rows of ``op8_mixing``; raking has a fixed point, which enough sweeps reach."""
    word = "[^ \t-\r]+"
    parts = [
        "texts as (select doc_id, source, lang, text, string_split(replace(coalesce(text, ''), chr(10), ' '), ' ') as words from documents)",
        "found as (select word, count(*) as n from (select unnest(list_distinct(words)) as word from texts) group by word)",
        f"""keys as (select coalesce(list(word order by n desc, word), []) as ks from
        (select * from found where {TOPIC_SHARE} * n <= (select count(*) from documents) and word <> '' order by n desc, word limit {topics}))""",
        "counted as (select t.*, ks, list_transform(ks, lambda k: len(list_filter(words, lambda w: w = k))) as ns from texts t, keys)",
        f"""marked as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang,
        case when list_max(ns) > 0 then ks[list_position(ns, list_max(ns))] else '' end as topic,
        coalesce(len(regexp_extract_all(text, '{word}')), 0)::bigint as tokens from counted)""",
        "cells as (select source, lang, topic, sum(tokens)::double as tokens from marked group by all having sum(tokens) > 0)",
    ]
    by = {"source": "source", "lang": "lang", "pair": "lang, topic"}
    raw = ", ".join(f"pow(sum(tokens) over (partition by {k}), {temper}) as r_{n}, count(*) over (partition by {k}) as k_{n}" for n, k in by.items())
    parts += [
        f"raw as (select *, {raw} from cells)",
        """aims as (select *, r_source / sum(r_source / k_source) over () as t_source, r_lang / sum(r_lang / k_lang) over () as t_lang,
        r_pair / k_pair / sum(r_pair / k_pair) over (partition by lang) as p_topic from raw)""",
        """w0 as (select source, lang, topic, tokens, t_source, t_lang, sum(t_lang * p_topic) over (partition by topic) as t_topic,
        tokens / sum(tokens) over () as weight from aims)""",
    ]
    step = "w0"
    for d in DIMS:
        source = "rakes where n < {}".format(sweeps) if step == "w0" else f"({step})"
        kept = "n + 1 as n, * exclude (n, weight)" if step == "w0" else "* exclude (weight)"
        step = f"select {kept}, weight * t_{d} / sum(weight) over (partition by {d}) as weight from {source}"
    parts.append(f"rakes as (select 0 as n, * from w0 union all {step})")
    parts += [
        f"whole as (select source, lang, topic, tokens, weight / sum(weight) over () as weight from rakes where n = {sweeps})",
        f"""filled as (select *, (sum(tokens) over () * {fraction} - (sum(tokens) over (order by tokens / weight, source, lang, topic
        rows between unbounded preceding and current row) - tokens)) / sum(weight) over (order by tokens / weight, source, lang, topic
        rows between current row and unbounded following) as factor from whole)""",
        "fitted as (select *, least(1.0, greatest(max(factor) over (), 0.0) * weight / tokens) as probability from filled)",
    ]
    return f"""with recursive {", ".join(parts)}
    select m.doc_id, m.source, m.lang, m.topic, m.tokens as n_tokens, round(coalesce(f.weight, 0), 7) as cell_weight,
    round(coalesce(f.probability, 0), 6) as probability,
    ('0x' || substr(md5(coalesce(m.doc_id::varchar, '') || ':{seed}'), 1, 13))::bigint / {1 << 52}::double < coalesce(f.probability, 0) as sampled
    from marked m left join fitted f using (source, lang, topic)"""
