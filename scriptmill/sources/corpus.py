"""The script corpus: one row (script_id, path, sql) per script.

``scan_folder`` reads ``*.sql`` files. ``scripts_from_orders`` derives a corpus from the orders table, one script per
order, with the order's key, date and status written into one of a list of script shapes; the same text is built in
SQL by ``SCRIPTS_SQL``, so that results can be compared between engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptmill.session import shuffle_partitions
from scriptmill.sources.files import whole_files
from scriptmill.sources.tables import table

# {k} order key, {d} yyyy-MM-dd, {ymd} yyyyMMdd, {s} status; \n is a newline.
SHAPES: list[str] = [
    "SELECT * FROM t_{ymd} WHERE id = {k};",
    "select a, b from t where name like '%{s}' and dt = '{ymd}';",
    "select a.x from a cross join b;\n-- done; {k}",
    "select cast(a as int), count(distinct b) from t group by a having count(1) > {k};",
    "select a from t where a = 1 or b = 2 or c = {k} order by a limit 5;",
    "select distinct a from t order by a;",
    "select a from t where order_date = '{d}';",
    "select a from t join u x on t.k = x.k;\nselect 1;",
    "select a from t where k in (select k from u) and j not in (select j from v);",
    "select a from t where k in (" + ", ".join(f"{{k}}{i:02d}" for i in range(40)) + ");",
    "select a from t where year(dt) = 1996 and f_{s}(x) > 2;",
    "select a, (select max(b) from u) from t;",
    "select a from t left join u on t.k = u.k and u.f = '{s}';",
    "select idcard from cust where id = {k};",
    "merge into t using s on t.id = s.id\nwhen matched and s.del = 1 then delete\n"
    "when matched then update set v = s.v\nwhen not matched then insert (id, v) values (s.id, s.v);",
    "create table if not exists w_{k} (id string comment 'key  ', amt decimal(22,2) comment 'amount') "
    "comment 'work' partitioned by (dt string);",
    "with a as (select x from t), b as (select x from u) select * from a union all select * from b;",
    "select x, row_number() over (partition by y order by z desc) rn from t;",
    "select id, tag from t lateral view outer explode(tags) g as tag group by id, tag;",
    "select case when a > 0 then case when b > 0 then 1 else 2 end else 0 end from t "
    "where s = 'x;y' /* c */;",
    "-- load of {d}\ndrop table if exists w_{k};\ncreate table w_{k} as\nselect a.id as id, -- the key\n"
    "  sum(a.amt) total /* in\ncents */\nfrom db.acc a full outer join rates r on a.cur = r.cur\n"
    "where a.note <> 'it''s; -- no comment' group by a.id;",
    "insert overwrite table rep partition (dt = '${TXDATE}')\nselect id, avg(v) over w m, "
    "sum(v) over (partition by g order by d rows between 2 preceding and current row) s\n"
    "from src where dt = '{DATA_DT}' window w as (partition by g order by d);",
    "merge into cust t using (select id, v, row_number() over (partition by id order by ts desc) rn from feed) s\n"
    "on t.id = s.id and s.rn = 1 when matched and s.note = 'WHEN in text' then update set v = "
    "case when s.v > 0 then s.v else 0 end\nwhen not matched then insert (id, v) values (s.id, s.v);",
    "create table rep_{k} (id int, name varchar(36)) comment 'report' partitioned by (dt string, org string) "
    "row format delimited stored as textfile;\nselect id, p, tag from pages lateral view posexplode(list) l as p, "
    "tag lateral view json_tuple(js, 'a') j as a where id > {k};\n"
    "select 1 from t where ((a = 1 or b = {k});",
    "select * from db.t where status = '{s}' or status = 'B' or x = {k} or status = 'C';",
    "select a.k, b.v from cat.db.fact a, dim_{ymd} b, w where extract(year from a.dt) = 1997 and a.k is distinct from b.k;",
    "with q as (select k from base), r as (select k from q where k > {k}) insert overwrite table out_t select q.k from r, q;",
    "select t.end, case t.a when 1 then 'one' end c from t;\nselect `select`, \"from x\" from `odd name` where v = {k};",
    "select a.x from a semi join b on a.x = b.x anti join c where upper(a.n) like 'X%' and my_udf(a.x, {k}) = 1;\n"
    "delete from old_{k} where dt < '{d}';\nupdate cust set v = 1 where id = {k};",
    "select f.a, (select max(v) from u where u.k = f.k) m from f left outer join g as h on f.k = h.k and f.flag = '{s}' "
    "and h.v > 0 where f.k in (select k from v1 where k not in (select k from v2)) and trim(both ' ' from f.s) = 'x';",
    "select " + ", ".join(f"sum(case when m = {i} then v end) m{i}" for i in range(6)) + " from wide where k = {k};",
]

# Scripts whose names mean different tables in different places.
SCOPE_SHAPES: list[str] = [
    "with c(n) as (select k from base_{s}) select n from c where n > {k}",
    "with c as (select k from c) select * from c join d_{ymd} d on c.k = d.k",
    "with recursive c as (select 1 k from seed union all select k + 1 from c where k < {k}) select * from c",
    "select * from (with c as (select 1 from x) select * from c) z, c where z.k = {k}",
    "with a as (with b as (select 1 from t) select * from b), b as (select * from a join b on a.k = b.k) select * from a, b;\n"
    "select * from a where dt = '{d}'",
    "insert into `my db`.`out {s}` with q (a, b) as (select 1, 2 from y) select a from `db`.tab, cat.db.f x, q where x.k = {k}",
    "select * from t join lateral (select v from u where u.k = t.k) z on true\nwhere t.k in (with t as (select 1 from w) select * from t)",
    "create table w_{k} as with r as (select k from base), s as (select * from r, (select * from r) r2) select * from s, r;\n"
    "drop table if exists w_{k};",
]

PLACEHOLDERS = ("{k}", "{d}", "{ymd}", "{s}")


def _pieces(shape: str) -> list[str]:
    """The shape cut into literal text and placeholders."""
    parts = [shape]
    for p in PLACEHOLDERS:
        parts = [x for part in parts for x in (_cut(part, p) if part not in PLACEHOLDERS else [part])]
    return [p for p in parts if p]


def _cut(text: str, mark: str) -> list[str]:
    out: list[str] = []
    for i, piece in enumerate(text.split(mark)):
        out += [mark, piece] if i else [piece]
    return out


def _sql_literal(text: str) -> str:
    quoted = text.replace("'", "''").replace("\n", "' || chr(10) || '")
    return f"'{quoted}'"


def scripts_sql(shapes: list[str]) -> str:
    """The corpus of these shapes as SQL over orders."""
    fills = {
        "{k}": "CAST(o_orderkey AS VARCHAR)",
        "{d}": "strftime(o_orderdate, '%Y-%m-%d')",
        "{ymd}": "strftime(o_orderdate, '%Y%m%d')",
        "{s}": "o_orderstatus",
    }
    arms = "\n".join(
        f"WHEN {i} THEN " + " || ".join(fills.get(p) or _sql_literal(p) for p in _pieces(s))
        for i, s in enumerate(shapes)
    )
    return (
        "SELECT o_orderkey AS script_id, "
        "'dir' || CAST(o_orderkey % 7 AS VARCHAR) || '/s' || CAST(o_orderkey AS VARCHAR) || '.sql' AS path,\n"
        f"CASE o_orderkey % {len(shapes)}\n{arms}\nEND AS sql\nFROM orders"
    )


# The same corpus in SQL.
SCRIPTS_SQL = scripts_sql(SHAPES)


def scripts_from_orders(spark: SparkSession, sf_dir: str, shapes: list[str] = SHAPES) -> DataFrame:
    """scripts(script_id, path, sql), one per order."""
    # Narrow rows become whole texts here, and texts many tokens. They are dealt out first, over a given number of partitions,
    # since AQE would merge them by the bytes they have now.
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderstatus").repartition(
        shuffle_partitions(spark), "o_orderkey")
    fills: dict[str, Column] = {
        "{k}": F.col("o_orderkey").cast("string"),
        "{d}": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "{ymd}": F.date_format("o_orderdate", "yyyyMMdd"),
        "{s}": F.col("o_orderstatus"),
    }
    shape = F.col("o_orderkey") % len(shapes)
    sql: Column | None = None
    for i, text in enumerate(shapes):
        value = F.concat(*[fills[p] if p in fills else F.lit(p) for p in _pieces(text)])
        sql = F.when(shape == i, value) if sql is None else sql.when(shape == i, value)
    key = F.col("o_orderkey")
    return orders.select(
        key.alias("script_id"),
        F.concat(F.lit("dir"), (key % 7).cast("string"), F.lit("/s"), key.cast("string"), F.lit(".sql")).alias("path"),
        sql.alias("sql"),
    )


def _one_per_script(files: DataFrame, separator: str | None) -> DataFrame:
    """(path, value) with one row per script: a file may be a bundle of scripts, each closed by the separator."""
    if separator is None:
        return files
    # the separator closes a script, so what follows the last one is no script; an empty one before it is
    pieces = F.split("value", f"\\Q{separator}\\E", -1)
    closed = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return files.select(F.posexplode(closed).alias("no", "value"), "path").select(
        F.concat_ws("#", "path", F.col("no").cast("string")).alias("path"), "value"
    )


# Columns of a scan of whole files. Files of length 0 are left out by Spark; a blank file is a row.
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def as_scripts(files: DataFrame, separator: str | None = None) -> DataFrame:
    """scripts(script_id, path, sql) from a batch or streaming scan of files; the path identifies the script. Bytes that
    are no UTF-8 become replacement characters."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = _one_per_script(files.select("path", text.alias("value")), separator)
    return rows.select(F.col("path").alias("script_id"), "path", F.col("value").alias("sql"))


def _files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    )


def scan_folder(spark: SparkSession, folder: str, glob: str = "*.sql", separator: str | None = None) -> DataFrame:
    """scripts(script_id, path, sql) for all matching files below a folder."""
    return as_scripts(_files(spark, folder, glob), separator)


def scan_folder_checked(spark: SparkSession, folder: str, glob: str = "*.sql") -> DataFrame:
    """Like ``scan_folder``, but every file gives a row: one that is no UTF-8 text or cannot be read has ``error`` instead of
    ``sql``, and an empty one an empty text."""
    valid = F.is_valid_utf8(F.col("content"))
    return whole_files(spark, folder, glob).select(
        F.col("path").alias("script_id"),
        "path",
        F.when(valid, F.decode("content", "UTF-8")).alias("sql"),
        F.coalesce("error", F.when(~valid, F.lit("not UTF-8 text"))).alias("error"),
    )


def write_bundles(scripts: DataFrame, folder: str, separator: str, per_file: int = 1000) -> None:
    """Append scripts as text files of at most ``per_file`` scripts each."""
    scripts.select("sql").write.mode("append").option("lineSep", separator).option("maxRecordsPerFile", per_file).text(folder)
