"""The canonical tables, made from other tables: named texts, two revisions, entity, link and cyclic graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _words():
    w = F.split("text", " ", -1)
    return F.slice(w, 1, 6), F.array_sort(F.array_distinct(F.slice(w, 7, 8)))


def definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Definitions from documents: equal beginnings in one language share a name."""
    deps, exports = _words()
    name = F.concat("lang", F.lit("."), F.substring(F.sha2(F.substring("text", 1, 24), 256), 1, 8))
    return table(spark, folder, "documents").select(
        name.alias("name"), F.format_string("%012d", "doc_id").alias("chunk"), F.lit(0).alias("pos"), deps.alias("deps"), exports.alias("exports"),
        F.expr("cast(array() as array<string>)").alias("functions"), F.sha2("text", 256).alias("raw_sha256"),
        F.octet_length("text").cast("long").alias("raw_len"), F.octet_length("text").cast("long").alias("stored_len"), F.lit("raw").alias("form"),
    )


def _revision(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    full = docs.withColumn("raw_sha256", F.sha2(F.concat_ws("|", "text", F.array_join("deps", " "), F.array_join("exports", " ")), 256))
    records = full.select("name", "deps", "exports", "raw_sha256", F.octet_length("text").cast("long").alias("stored_len"))
    return records, full.select("name", F.col("raw_sha256").alias("sha256"), "text")


def revisions(spark: SparkSession, folder: str):
    """((records, sources) of the older, (records, sources) of the newer): documents with lines, dependencies
    and exports added to some, and some on one side only."""
    deps, exports = _words()
    docs = table(spark, folder, "documents").select("doc_id", F.concat_ws(".", "source", "lang", F.col("doc_id").cast("string")).alias("name"), F.concat("text", F.lit("\n")).alias("text"), deps.alias("deps"), exports.alias("exports"))
    k = F.col("doc_id")
    extra = F.when(k % 14 == 0, "babelHelpers.extends(a)\n").when(k % 7 == 0, F.concat(F.lit("added line "), k.cast("string"), F.lit("\nsecond added line\n"))).otherwise("")
    none = F.expr("cast(array() as array<string>)")
    more = F.concat(F.when(k % 14 == 0, F.array(F.lit("React"))).otherwise(none), F.when(k % 21 == 0, F.array(F.lit("added_sym"))).otherwise(none))
    newer = docs.where(k % 10 != 1).withColumns({
        "text": F.concat("text", extra), "deps": F.concat("deps", more),
        "exports": F.array_sort(F.array_distinct(F.concat("exports", F.when(k % 21 == 0, F.array(F.lit("added_sym"))).otherwise(none)))),
    })
    return _revision(docs.where(k % 10 != 0)), _revision(newer)


def _named(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def entity_edges(spark: SparkSession, folder: str) -> DataFrame:
    """src, pos and dst among orders, customers, parts, suppliers, nations and regions."""
    t = lambda n: table(spark, folder, n)
    line = t("lineitem").select(_named("order", "l_orderkey").alias("src"), "l_linenumber", _named("part", "l_partkey").alias("p"), _named("supplier", "l_suppkey").alias("s"))
    parts = line.select("src", F.inline(F.array(F.struct((2 * F.col("l_linenumber") - 1).alias("pos"), F.col("p").alias("dst")), F.struct((2 * F.col("l_linenumber")).alias("pos"), F.col("s").alias("dst")))))
    zero = F.lit(0).alias("pos")
    return (
        t("orders").select(_named("order", "o_orderkey").alias("src"), zero, _named("customer", "o_custkey").alias("dst"))
        .unionByName(parts.groupBy("src", "dst").agg(F.min("pos").alias("pos")))
        .unionByName(t("customer").select(_named("customer", "c_custkey").alias("src"), zero, _named("nation", "c_nationkey").alias("dst")))
        .unionByName(t("supplier").select(_named("supplier", "s_suppkey").alias("src"), zero, _named("nation", "s_nationkey").alias("dst")))
        .unionByName(t("nation").select(_named("nation", "n_nationkey").alias("src"), zero, _named("region", "n_regionkey").alias("dst")))
    )


def entity_names(spark: SparkSession, folder: str) -> DataFrame:
    """The names of orders, customers, suppliers, parts and nations; regions are not defined."""
    t = lambda n: table(spark, folder, n)
    names = t("orders").select(_named("order", "o_orderkey").alias("name"))
    for n, kind, key in (("customer", "customer", "c_custkey"), ("supplier", "supplier", "s_suppkey"), ("part", "part", "p_partkey"), ("nation", "nation", "n_nationkey")):
        names = names.unionByName(t(n).select(_named(kind, key).alias("name")))
    return names


def entity_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, edges) of entity_names() and entity_edges()."""
    edges, names = entity_edges(spark, folder), entity_names(spark, folder)
    own = edges.groupBy(F.col("src").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x.dst).alias("deps"))
    return names.join(own, "name", "left").withColumn("deps", F.coalesce("deps", F.expr("cast(array() as array<string>)"))), edges


def link_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, edges) of pages and the targets of their links, none of which is a page's name."""
    deps = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    pages = table(spark, folder, "pages").select(_named("page", "page_id").alias("name"), deps.alias("deps"))
    return pages, pages.select(F.col("name").alias("src"), F.posexplode("deps").alias("pos", "dst"))


def cyclic_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, edges): every document leads to one other."""
    docs = table(spark, folder, "documents").select("doc_id")
    n = docs.agg(F.count("*").alias("n"))
    edges = docs.crossJoin(F.broadcast(n)).select(_named("doc", "doc_id").alias("src"), F.lit(0).alias("pos"), F.concat(F.lit("doc:"), ((7 * F.col("doc_id") + 3) % F.col("n")).cast("string")).alias("dst"))  # one row on the right
    return edges.select(F.col("src").alias("name"), F.array("dst").alias("deps")), edges


def chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk files made from documents, as archive.chunks() gives them: calls with facts of the document, some with a
    second definition whose name is shared, some broken, not UTF-8, not scripts or with a call without a name."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    num = lambda n: (k % n).cast("string")
    own = F.concat(
        F.lit('__d("Doc'), k.cast("string"), F.lit('",["Doc'), num(97), F.lit('","'), F.coalesce("lang", F.lit("")), F.lit('"],(function(t,n,r,o,a,i){function run'), num(7), F.lit('(){return "'),
        F.sha2(text, 256), F.lit('"}\nvar k=1\nfunction go'), num(4), F.lit("(){}\nvar f=()=>k\ni.make"), num(3), F.lit("=run"), num(7), F.lit(";a.exports.extra=2}),"), k.cast("string"), F.lit(")"),
    )
    second = F.when(k % 4 == 0, F.concat(F.lit('\n;__d("Shared'), num(40), F.lit('",["x'), num(3), F.lit('"],function(){return "'), F.coalesce("source", F.lit("")), F.lit('"},1)'))).otherwise("")
    script = F.concat(own, second, F.when(k % 11 == 1, ";__d(some,[],f,1)").otherwise(""), F.when(k % 11 == 0, "(").otherwise(";"))
    content = F.concat(script.cast("binary"), F.when(k % 13 == 0, F.unhex(F.lit("FFFE"))).otherwise(F.unhex(F.lit(""))))
    path = F.concat(F.lit("c/"), k.cast("string"), F.when(k % 11 == 2, ".txt").otherwise(".js"))
    rows = table(spark, folder, "documents").select(path.alias("path"), content.alias("content"))
    return rows.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"), "content", (~F.col("path").rlike(r"\.js\z")).alias("skipped"))


def edited(spark: SparkSession, folder: str):
    """((records, sources) of the older, the same of the newer): documents with numbered lines, of which the newer ones
    lose some, replace some, gain some, and in part have no line end at their end."""
    k = F.col("doc_id")
    ls = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))
    none = F.expr("cast(array() as array<string>)")

    def new(x, i):
        n = i + 1
        own = F.when(n % 5 == k % 5, none).when(n % 7 == k % 7, F.array(F.concat(x, F.lit("!")))).otherwise(F.array(x))
        return F.concat(own, F.when(n % 11 == k % 11, F.array(F.concat(F.lit("new "), n.cast("string")))).otherwise(none))

    docs = table(spark, folder, "documents").select("doc_id", F.concat(F.lit("doc."), k.cast("string")).alias("name"), none.alias("deps"), none.alias("exports"), ls.alias("ls"))
    joined = lambda c, end: F.concat(F.array_join(c, "\n"), end)
    old = docs.withColumn("text", joined("ls", F.lit("\n")))
    newer = docs.withColumn("ls", F.flatten(F.transform("ls", new))).withColumn("text", F.when(F.size("ls") == 0, "").otherwise(joined("ls", F.when(k % 3 == 0, "").otherwise("\n"))))
    return _revision(old), _revision(newer)


def rings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, edges): documents in rings of five neighbours by number, where all five are there or not."""
    a = F.col("doc_id")
    edges = table(spark, folder, "documents").select(_named("doc", "doc_id").alias("src"), F.lit(0).alias("pos"), F.concat(F.lit("doc:"), (a - a % 5 + (a + 1) % 5).cast("string")).alias("dst"))
    return edges.select(F.col("src").alias("name"), F.array("dst").alias("deps")), edges
