"""Scalar, text, array, map, matrix and colour functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import color as C
from ..functions import na as N
from ..functions import numeric as M
from ..functions import text as S
from .common import shown, sql6, sql_shown, table


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values on both sides of zero, some of them NULL."""
    p = table(spark, sf_dir, "part")
    k, r = F.col("p_partkey"), F.col("p_retailprice")
    return p.select(k, F.when(k % 7 != 0, (k % 41 - 20) / F.lit(4.0)).alias("a"), F.when(k % 11 != 0, (k % 13 - 6).cast("double")).alias("b"), r)


def fn_na_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic and comparisons with missing values: / % == != < <= > >= and or not ?: switch nz na."""
    a, b = F.col("a"), F.col("b")
    flag = lambda c: c.cast("int")
    return shown(_numbers(spark, sf_dir), ["p_partkey"], {
        "div": N.div(a, b), "mod": N.mod(a, b), "eq": flag(N.eq(a, b)), "ne": flag(N.ne(a, b)), "lt": flag(N.lt(a, b)), "le": flag(N.le(a, b)), "gt": flag(N.gt(a, b)), "ge": flag(N.ge(a, b)),
        "and_": flag(N.and_(a, b)), "or_": flag(N.or_(a, b)), "not_": flag(N.not_(a)), "iff": N.iff(N.gt(a, b), a, b), "nz": N.nz(a, -1.0), "na": flag(N.na(a)), "switch": N.switch(b, [(F.lit(None).cast("double"), F.lit(1.0)), (F.lit(2.0), F.lit(2.0))], F.lit(0.0)),
    })


_NUM = "n AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 41 - 20) / 4.0::DOUBLE END AS a, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey % 13 - 6 AS DOUBLE) END AS b, p_retailprice FROM part)"
_NA = {
    "div": "a / nullif(b, 0)", "mod": "a - b * floor(a / nullif(b, 0))", "eq": "coalesce((a = b)::INT, 0)", "ne": "coalesce((a <> b)::INT, 0)", "lt": "coalesce((a < b)::INT, 0)", "le": "coalesce((a <= b)::INT, 0)", "gt": "coalesce((a > b)::INT, 0)", "ge": "coalesce((a >= b)::INT, 0)",
    "and_": "(coalesce(a, 0) <> 0 AND coalesce(b, 0) <> 0)::INT", "or_": "(coalesce(a, 0) <> 0 OR coalesce(b, 0) <> 0)::INT", "not_": "(coalesce(a, 0) = 0)::INT", "iff": "CASE WHEN a > b THEN a ELSE b END", "nz": "coalesce(a, -1)", "na": "(a IS NULL)::INT", "switch": "CASE WHEN b IS NULL THEN 1 WHEN b = 2 THEN 2 ELSE 0 END",
}


def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """abs max min sign pow sqrt log log10 exp floor ceil acos asin atan cos sin tan round round_to_mintick avg int float todegrees toradians random."""
    a, b, r = F.col("a"), F.col("b"), F.col("p_retailprice")
    return shown(_numbers(spark, sf_dir), ["p_partkey"], {
        "abs": F.abs(a), "max": M.max_(a, b), "min": M.min_(a, b), "sign": M.sign(a), "pow": M.pow_(a, F.lit(3.0)), "sqrt": M.sqrt(a), "log": M.log(r), "log10": M.log10(r), "exp": M.exp(a), "floor": F.floor(a), "ceil": F.ceil(a), "acos": M.acos(a / 5), "asin": M.asin(a / 5), "atan": F.atan(a),
        "cos": F.cos(a), "sin": F.sin(a), "tan": F.tan(a), "round": M.round_(a), "round_1": M.round_(a, 1), "mintick": M.round_to_tick(r, 0.05), "avg": M.avg(a, b), "int": M.int_(a), "degrees": F.degrees(a), "radians": F.radians(a), "tonumber": M.tonumber(F.format_number(r, 2)),
        "random": M.random(F.lit(0.0), F.lit(1.0), F.lit(42), F.col("p_partkey")),
    })


_M32 = "4294967295"
_RND = f"x0 AS (SELECT *, xor((42 * 2654435761) % 4294967296, CAST(((p_partkey + 1)::HUGEINT * 2246822507) % 4294967296 AS BIGINT)) AS x FROM n), x1 AS (SELECT * EXCLUDE x, xor(x, CAST((x::HUGEINT * 8192) % 4294967296 AS BIGINT)) AS x FROM x0), x2 AS (SELECT * EXCLUDE x, xor(x, x >> 17) AS x FROM x1), x3 AS (SELECT * EXCLUDE x, xor(x, CAST((x::HUGEINT * 32) % 4294967296 AS BIGINT)) AS x FROM x2)"
_MATH = {
    "abs": "abs(a)", "max": "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END", "min": "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END", "sign": "sign(a)", "pow": "pow(a, 3)", "sqrt": "CASE WHEN a >= 0 THEN sqrt(a) END", "log": "ln(p_retailprice)", "log10": "log10(p_retailprice)", "exp": "exp(a)",
    "floor": "floor(a)", "ceil": "ceil(a)", "acos": "CASE WHEN abs(a / 5) <= 1 THEN acos(a / 5) END", "asin": "CASE WHEN abs(a / 5) <= 1 THEN asin(a / 5) END", "atan": "atan(a)", "cos": "cos(a)", "sin": "sin(a)", "tan": "tan(a)", "round": "floor(a + 0.5)", "round_1": "floor(a * 10 + 0.5) / 10",
    "mintick": "round(floor(p_retailprice / 0.05 + 0.5) * 0.05, 2)", "avg": "CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END", "int": "trunc(a)", "degrees": "degrees(a)", "radians": "radians(a)", "tonumber": "round(p_retailprice, 2)", "random": "x / 4294967296.0::DOUBLE",
}


def fn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tostring tonumber format replace replace_all contains startswith endswith length substring split join repeat lower upper trim pos match volume percent."""
    p = table(spark, sf_dir, "part")
    n, k, r = F.col("p_name"), F.col("p_partkey"), F.col("p_retailprice")
    return p.select(
        "p_partkey", S.tostring(r, 1).alias("tostring"), S.format_("{0}: {1,#.00} / {0}", n, r).alias("format"), S.replace_first(n, "a", "<A>").alias("replace"), S.replace_all(n, "a", "<A>").alias("replace_all"), S.contains(n, F.lit("ar")).alias("contains"),
        S.startswith(n, F.lit("p")).alias("startswith"), S.endswith(n, F.lit("1")).alias("endswith"), S.length(n).alias("length"), S.substring(n, F.lit(1), F.lit(4)).alias("substring"), S.join(S.split(n, " "), "|").alias("join"), F.size(S.split(n, "a")).alias("parts"), S.repeat(F.left(n, F.lit(2)), k.cast("int") % 4).alias("repeat"),
        S.lower(n).alias("lower"), S.upper(n).alias("upper"), S.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("trim"), S.pos(n, F.lit("t")).alias("pos"), S.match(n, "[aeiou]{2}").alias("match"), S.volume(k * 12345.67).alias("volume"), S.percent(r / 7).alias("percent"),
    )


_TRIMMED = "regexp_replace(regexp_replace(printf('%.3f', {}), '0+$', ''), '[.]$', '')"
_TEXT = {
    "tostring": "printf('%.1f', p_retailprice)", "format": "p_name || ': ' || printf('%.2f', p_retailprice) || ' / ' || p_name", "replace": "regexp_replace(p_name, 'a', '<A>')", "replace_all": "replace(p_name, 'a', '<A>')", "contains": "contains(p_name, 'ar')", "startswith": "starts_with(p_name, 'p')", "endswith": "ends_with(p_name, '1')",
    "length": "CAST(length(p_name) AS INT)", "substring": "substring(p_name, 2, 3)", "join": "array_to_string(string_split(p_name, ' '), '|')", "parts": "CAST(len(string_split(p_name, 'a')) AS INT)", "repeat": "repeat(left(p_name, 2), p_partkey % 4)", "lower": "lower(p_name)", "upper": "upper(p_name)", "trim": "trim(p_name)",
    "pos": "CAST(instr(p_name, 't') - 1 AS INT)", "match": "regexp_matches(p_name, '[aeiou]{2}')",
    "volume": "CASE WHEN v >= 1e9 THEN " + _TRIMMED.format("v / 1e9") + " || 'B' WHEN v >= 1e6 THEN " + _TRIMMED.format("v / 1e6") + " || 'M' WHEN v >= 1e3 THEN " + _TRIMMED.format("v / 1e3") + " || 'K' ELSE " + _TRIMMED.format("v") + " END", "percent": "printf('%.2f', p_retailprice / 7) || '%'",
}


def fn_array_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sum avg max min range median mode variance stdev percentrank standardize covariance correlation percentiles abs every some, of whole vectors (y) and of their rounded tenfold (x)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 10)).alias("x"), F.transform("embedding", lambda x: x.cast("double")).alias("y"))
    x, y = F.col("x"), F.col("y")
    at = lambda a, i: F.get(a, F.lit(i))
    return shown(e, ["vec_id"], {
        "sum": A.sum_(y), "avg": A.avg(y), "max": A.max_(y), "min": A.min_(y), "range": A.range_(y), "median": A.median(y), "median_rounded": A.median(x), "mode": A.mode(x), "variance": A.variance(y), "variance_sample": A.variance(y, False), "stdev": A.stdev(y), "percentrank": A.percentrank(x, F.lit(0.0)),
        "standardized": at(A.standardize(y), 3), "covariance": A.covariance(x, y), "correlation": A.correlation(x, y), "linear": A.percentile_linear_interpolation(y, 30), "nearest": A.percentile_nearest_rank(y, 30), "abs": A.sum_(A.abs_(y)), "every": A.every(x).cast("int"), "some": A.some(x).cast("int"),
    })


_EMB = "e0 AS (SELECT vec_id, list_transform(embedding, lambda v: round(CAST(v AS DOUBLE) * 10)) AS x, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS y FROM embeddings), e AS (SELECT *, len(y) AS n, list_sort(y) AS s, list_avg(x) AS mx, list_avg(y) AS my FROM e0), f AS (SELECT *, sqrt(list_avg(list_transform(y, lambda v: (v - my) * (v - my)))) AS sy, sqrt(list_avg(list_transform(x, lambda v: (v - mx) * (v - mx)))) AS sdx, list_avg(list_transform(range(1, n + 1), lambda k: (x[k] - mx) * (y[k] - my))) AS cov, 0.3::DOUBLE * (n - 1) AS pos FROM e)"
_ARR = {
    "sum": "list_sum(y)", "avg": "my", "max": "list_max(y)", "min": "list_min(y)", "range": "list_max(y) - list_min(y)", "median": "list_aggregate(y, 'median')", "median_rounded": "list_aggregate(x, 'median')", "mode": "list_reduce(list_transform(x, lambda v: {'n': len(list_filter(x, lambda w: w = v)), 'v': v}), lambda a, b: CASE WHEN b.n > a.n THEN b ELSE a END).v",
    "variance": "sy * sy", "variance_sample": "sy * sy * n / (n - 1)", "stdev": "sy", "percentrank": "100.0 * len(list_filter(x, lambda v: v <= 0)) / n", "standardized": "(y[4] - my) / sy", "covariance": "cov", "correlation": "cov / nullif(sdx * sy, 0)", "linear": "s[floor(pos)::INT + 1] + (s[floor(pos)::INT + 2] - s[floor(pos)::INT + 1]) * (pos - floor(pos))", "nearest": "s[ceil(0.3 * n)::INT]",
    "abs": "list_sum(list_transform(y, lambda v: abs(v)))", "every": "(len(list_filter(x, lambda v: v = 0)) = 0)::INT", "some": "(len(list_filter(x, lambda v: v <> 0)) > 0)::INT",
}


def fn_array_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """get first last push unshift pop shift set insert remove fill slice concat includes indexof lastindexof reverse sort sort_indices binary_search join."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 10).cast("int")).alias("x"))
    x, i = F.col("x"), F.lit
    show = lambda a: A.join(a, ",")
    return e.select(
        "vec_id", A.get(x, i(2)).alias("get"), A.first(x).alias("first"), A.last(x).alias("last"), show(A.push(x, i(7))).alias("push"), show(A.unshift(x, i(7))).alias("unshift"), show(A.pop(x)[0]).alias("pop"), show(A.shift(x)[0]).alias("shift"), show(A.set_(x, i(1), i(9))).alias("set"), show(A.insert(x, i(2), i(9))).alias("insert"),
        show(A.remove(x, i(2))[0]).alias("remove"), show(A.fill(x, i(0), 1, 3)).alias("fill"), show(A.slice_(x, 1, -1)).alias("slice"), show(A.concat(x, x)).alias("concat"), A.includes(x, i(1)).alias("includes"), A.indexof(x, i(1)).alias("indexof"), A.lastindexof(x, i(1)).alias("lastindexof"), show(A.reverse(x)).alias("reverse"),
        show(A.sort(x)).alias("sort"), show(A.sort(x, False)).alias("sort_down"), show(A.sort_indices(x)).alias("sort_indices"), A.binary_search(A.sort(x), i(1)).alias("search"), A.binary_search_rightmost(A.sort(x), i(1)).alias("search_right"),
    )


_ACC = {
    "get": "x[3]", "first": "x[1]", "last": "x[n]", "push": "list_append(x, 7)", "unshift": "list_prepend(7, x)", "pop": "x[1:n - 1]", "shift": "x[2:n]", "set": "[x[1], 9] || x[3:n]", "insert": "x[1:2] || [9] || x[3:n]", "remove": "x[1:2] || x[4:n]", "fill": "[x[1], 0, 0] || x[4:n]", "slice": "x[2:n - 1]", "concat": "x || x",
    "includes": "list_contains(x, 1)", "indexof": "CAST(coalesce(list_position(x, 1), 0) - 1 AS INT)", "lastindexof": "CAST(CASE WHEN list_contains(x, 1) THEN n - list_position(list_reverse(x), 1) ELSE -1 END AS INT)", "reverse": "list_reverse(x)", "sort": "list_sort(x)", "sort_down": "list_reverse_sort(x)",
    "sort_indices": "list_transform(list_sort(list_transform(range(1, n + 1), lambda k: {'x': x[k], 'k': k - 1})), lambda s: s.k)", "search": "CAST(CASE WHEN list_contains(x, 1) THEN len(list_filter(x, lambda v: v < 1)) ELSE -len(list_filter(x, lambda v: v < 1)) - 1 END AS INT)",
    "search_right": "CAST(CASE WHEN list_contains(x, 1) THEN len(list_filter(x, lambda v: v <= 1)) - 1 ELSE -len(list_filter(x, lambda v: v < 1)) - 1 END AS INT)",
}
_LISTS = {"push", "unshift", "pop", "shift", "set", "insert", "remove", "fill", "slice", "concat", "reverse", "sort", "sort_down", "sort_indices"}


def fn_maps_and_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map.put get contains size keys values put_all remove; matrix.new set get row add_row remove_row rows columns."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_nationkey")
    m = A.map_put(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), k), F.lit("a"), k + 1)
    both = A.map_put_all(m, F.create_map(F.lit("b"), F.lit(7), F.lit("c"), F.lit(8)))
    x = A.matrix_set(A.matrix_new(2, 3, F.lit(0)), F.lit(1), F.lit(2), k)
    y = A.matrix_add_row(x, F.lit(1), F.array(k, k + 1, k + 2))
    return c.select(
        "c_custkey", A.map_get(m, F.lit("a")).alias("a"), A.map_get(m, F.lit("z")).alias("missing"), F.map_contains_key(m, F.lit("b")).alias("has"), F.size(both).alias("size"), F.array_join(F.array_sort(F.map_keys(both)), ",").alias("keys"), F.aggregate(F.map_values(both), F.lit(0), lambda s, v: s + v).alias("total"),
        F.size(A.map_remove(both, F.lit("c"))[0]).alias("left"), A.map_remove(both, F.lit("c"))[1].alias("removed"), A.matrix_rows(y).alias("rows"), A.matrix_columns(y).alias("columns"), A.matrix_get(y, F.lit(2), F.lit(2)).alias("cell"), A.join(A.matrix_row(y, F.lit(1)), ",").alias("row"), A.matrix_rows(A.matrix_remove_row(y, F.lit(0))[0]).alias("rows_left"),
    ).drop("missing")


def fn_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rgb new from_gradient r g b t."""
    k = F.col("p_partkey").cast("int")
    c = C.rgb(k % 256, (k * 7) % 256, (k * 13) % 256)
    faded = C.new(c, F.lit(40))
    mid = C.from_gradient((k % 100).cast("double"), F.lit(0.0), F.lit(99.0), F.lit("#000000FF"), F.lit("#FF0000FF"))
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("rgb"), faded.alias("new"), C.red(faded).alias("r"), C.green(faded).alias("g"), C.blue(faded).alias("b"), C.transparency(faded).alias("t"), C.red(mid).alias("mid"))


def fn_color_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of texts and of numbers; a part without a positive price ends the run."""
    k, price = F.col("p_partkey"), F.col("p_retailprice").cast("double")
    c = C.cast(F.concat(F.lit("#"), F.lpad(F.hex(k), 6, "0"), F.lit("FF")))
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("of_text"), C.cast(k).alias("of_number"), C.blue(c).alias("blue"), N.check(price > 0, price, "a part has no price").alias("price"))


_HEX = "printf('%02X%02X%02X', k % 256, (k * 7) % 256, (k * 13) % 256)"

QUERIES = {f.__name__: f for f in (fn_na_semantics, fn_math, fn_text, fn_array_statistics, fn_array_access, fn_maps_and_matrices, fn_colors, fn_color_casts)}
SQL = {
    "fn_na_semantics": f"WITH {_NUM} SELECT p_partkey, {sql_shown(_NA)} FROM n",
    "fn_math": f"WITH {_NUM}, {_RND} SELECT p_partkey, {sql_shown(_MATH)} FROM x3",
    "fn_text": f"SELECT p_partkey, {', '.join(f'{e} AS {k}' for k, e in _TEXT.items())} FROM (SELECT *, p_partkey * 12345.67::DOUBLE AS v FROM part)",
    "fn_array_statistics": f"WITH {_EMB} SELECT vec_id, {', '.join(f'{sql6(e)} AS {k}' for k, e in _ARR.items())} FROM f",
    "fn_array_access": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(CAST(v * 10 AS FLOAT)) AS INT)) AS x, len(embedding) AS n FROM embeddings) SELECT vec_id, " + ", ".join(f"array_to_string({e}, ',') AS {k}" if k in _LISTS else f"{e} AS {k}" for k, e in _ACC.items()) + " FROM e",
    "fn_maps_and_matrices": "SELECT c_custkey, k + 1 AS a, true AS has, 3 AS size, 'a,b,c' AS keys, CAST(k + 16 AS INT) AS total, 2 AS \"left\", 8 AS removed, 3 AS rows, 3 AS columns, k AS cell, k || ',' || (k + 1) || ',' || (k + 2) AS row, 2 AS rows_left FROM (SELECT c_custkey, c_nationkey AS k FROM customer)",
    "fn_color_casts": "SELECT p_partkey, '#' || printf('%06X', p_partkey) || 'FF' AS of_text, CAST(p_partkey AS VARCHAR) AS of_number, CAST(p_partkey % 256 AS INT) AS blue, CAST(p_retailprice AS DOUBLE) AS price FROM part",
    "fn_colors": f"SELECT p_partkey, '#' || {_HEX} || 'FF' AS rgb, '#' || {_HEX} || '99' AS new, CAST(k % 256 AS INT) AS r, CAST((k * 7) % 256 AS INT) AS g, CAST((k * 13) % 256 AS INT) AS b, 40 AS t, CAST(round(255 * (k % 100) / 99.0) AS INT) AS mid FROM (SELECT p_partkey, p_partkey AS k FROM part)",
}
