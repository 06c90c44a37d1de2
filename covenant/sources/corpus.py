"""Sources: JSONL chunks, page text, filings, and a contract corpus derived from order tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.vocab import QUESTIONS

#: The contract corpus in SQL that both engines read; {date} formats a timestamp as "Month d, yyyy".
CONTRACTS = """
SELECT o.o_orderkey AS doc_id, cast(o.o_orderkey % 5 AS int) AS kind,
  concat(
    CASE o.o_orderkey % 5 WHEN 0 THEN 'LEASE AGREEMENT' WHEN 1 THEN 'PURCHASE AGREEMENT' WHEN 2 THEN 'PROPERTY MANAGEMENT AGREEMENT'
      WHEN 3 THEN 'CONSTRUCTION CONTRACT' ELSE 'LOAN AGREEMENT' END, chr(10),
    'effective date as of ', {order_date}, chr(10),
    CASE WHEN o.o_orderkey % 20 = 7 THEN 'This deed is made BETWEEN'
      WHEN o.o_orderkey % 5 = 0 THEN 'Lessor' WHEN o.o_orderkey % 5 = 1 THEN 'Seller' WHEN o.o_orderkey % 5 = 2 THEN 'Owner' WHEN o.o_orderkey % 5 = 3 THEN 'Contractor' ELSE 'Lender' END,
    ' Sup', translate(cast(l.sk AS {string}), '0123456789', 'abcdefghij'), ' Holdings LLC', CASE WHEN o.o_orderkey % 20 = 7 THEN ' and' ELSE chr(10) END,
    CASE WHEN o.o_orderkey % 20 = 7 THEN ''
      WHEN o.o_orderkey % 5 = 0 THEN 'Lessee' WHEN o.o_orderkey % 5 = 1 THEN 'Buyer' WHEN o.o_orderkey % 5 = 2 THEN 'Manager' WHEN o.o_orderkey % 5 = 3 THEN 'Owner' ELSE 'Borrower' END,
    ' Cus', translate(cast(o.o_custkey AS {string}), '0123456789', 'abcdefghij'), ' Trading Limited', CASE WHEN o.o_orderkey % 20 = 7 THEN ' (the signatories)' ELSE '' END, chr(10),
    'ARTICLE 1 - PAYMENT', chr(10),
    'The ', CASE o.o_orderkey % 5 WHEN 0 THEN 'monthly rent' WHEN 1 THEN 'purchase price' WHEN 2 THEN 'management fee'
      WHEN 3 THEN 'contract value' ELSE 'loan amount' END, ' is $', cast(cast(o.o_totalprice AS decimal(12,2)) AS {string}), ' payable monthly.', chr(10),
    'ARTICLE 2 - TERM', chr(10),
    'The term of ', cast(l.n AS {string}), ' years expires; termination date ', {ship_date}, '.', chr(10),
    'Section 2.1 Area', chr(10),
    'Premises of ', cast(l.qty AS {string}), ' square feet.', chr(10),
    CASE o.o_orderkey % 4
      WHEN 0 THEN concat('ARTICLE 3', chr(10), 'See Clause ', cast(l.n AS {string}), ' and Paragraph 2.3 for what both sides owe.')
      WHEN 1 THEN concat('Payment Schedule', chr(10), 'A deposit of USD $', cast(o.o_orderkey % 97 * 50 + 500 AS {string}), ' falls due on ', {iso_date}, ' at the office.')
      WHEN 2 THEN concat('(a) Fees', chr(10), 'The property address is 12 Lake Road Dhaka; represented by Karim Rahman from Sept 3 2001 on.')
      ELSE concat('GENERAL CONDITIONS', chr(10), 'An interest rate of 5.25% applies. Commencement date March 3, 2001.', chr(10), 'IN WITNESS WHEREOF this is signed by Anna Maria Lee.') END) AS text
FROM orders o JOIN (
  SELECT l_orderkey, min(l_suppkey) AS sk, count(*) AS n, cast(sum(l_quantity) AS bigint) AS qty, min(l_shipdate) AS sd
  FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition at most, about, where rows are dealt out by key for work that needs much more room than they do.
PART_ROWS = 100_000


def parts_for(rows: DataFrame) -> int:
    """Partitions enough for every core, and more the more rows there are.

    Spark sizes partitions by the bytes of what is shuffled, which are few where texts and lines are made afterwards.
    """
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by a key over parts_for() partitions."""
    return rows.repartition(parts_for(rows), key)


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind, text: one contract per order, joined to its summed-up lines.

    Orders and their lines are dealt out by key, and what is made of a contract stays there, so that windows and groups by doc_id need no shuffle.
    """
    sql = CONTRACTS.format(string="string", order_date="date_format(o.o_orderdate, 'MMMM d, yyyy')", ship_date="date_format(l.sd, 'MMMM d, yyyy')", iso_date="date_format(l.sd, 'yyyy-MM-dd')")
    sql = sql.replace("FROM orders", "FROM {orders}").replace("FROM lineitem", "FROM {lineitem}")
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    n = parts_for(orders)
    return spark.sql(sql, orders=orders.repartition(n, "o_orderkey").hint("merge"), lineitem=lines.repartition(n, "l_orderkey"))


CONTRACTS_DUCKDB = CONTRACTS.format(string="varchar", order_date="strftime(o.o_orderdate, '%B %-d, %Y')", ship_date="strftime(l.sd, '%B %-d, %Y')", iso_date="strftime(l.sd, '%Y-%m-%d')")


def questions(spark: SparkSession) -> DataFrame:
    """qid, question: the canned workload."""
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "qid int, question string")


#: Questions in SQL that both engines read: what is asked in conversations, each after a canned one, and benchmark items.
ASKED = """
SELECT conv_id * 100000 + turn AS qid, trim(concat({canned}, ' ', coalesce(text, ''))) AS question FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
UNION ALL SELECT -1 - item_id, trim(coalesce(text, '')) FROM benchmark WHERE item_id IS NOT NULL
"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question: every turn of the conversations after a canned question, and every benchmark item."""
    names = ", ".join("'" + q.replace("'", "\\'") + "'" for q in QUESTIONS)
    sql = ASKED.format(canned=f"element_at(array({names}), cast((conv_id + turn) % {len(QUESTIONS)} + 1 AS int))")
    sql = sql.replace("FROM conversations", "FROM {conversations}").replace("FROM benchmark", "FROM {benchmark}")
    rows = spark.sql(sql, conversations=table(spark, sf_dir, "conversations"), benchmark=table(spark, sf_dir, "benchmark"))
    return rows.select("qid", t.trim(F.col("question")).alias("question"))


ASKED_DUCKDB = ASKED.format(canned="list_extract([" + ", ".join("'" + q.replace("'", "''") + "'" for q in QUESTIONS) + f"], ((conv_id + turn) % {len(QUESTIONS)} + 1)::int)")


def jsonl_chunks(spark: SparkSession, path: str, keep_empty: bool = True) -> DataFrame:
    """id, text, metadata (JSON) of each valid line of the JSONL files in path.

    Blank and malformed lines are skipped; chunk_id and content are accepted for id
    and text; a line without id gets the file's name and its number among the valid
    lines. keep_empty=False is the older ingest: it looks into subfolders as well and
    skips rows without id or text. Only lines without id are numbered, without their texts.
    """
    lines = spark.read.text(path, recursiveFileLookup=not keep_empty, pathGlobFilter="*.jsonl").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.monotonically_increasing_id().alias("at"))
    parsed = lines.select("file", "name", "at", F.from_json("value", "id string, chunk_id string, text string, content string, metadata string", {"mode": "PERMISSIVE"}).alias("j"), F.try_parse_json("value").alias("v"))
    valid = parsed.where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    own = F.coalesce(F.nullif("j.id", F.lit("")), F.nullif("j.chunk_id", F.lit("")))
    rows = valid.select("file", "name", "at", own.alias("own"), F.coalesce("j.text", "j.content", F.lit("")).alias("text"), F.coalesce("j.metadata", F.lit("{}")).alias("metadata"))
    named = rows.where("own is not null").select(F.col("own").alias("id"), "text", "metadata")
    if not keep_empty:
        return named.where(F.trim("text") != "")
    nth = F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1
    made = rows.select("file", "name", "at", "own").withColumn("nth", nth).where("own is null")
    made = made.select("file", "at", F.concat(F.regexp_replace("name", r"\.jsonl$", ""), F.lit("_"), "nth").alias("id"))
    return named.unionByName(rows.where("own is null").join(made, ["file", "at"]).select("id", "text", "metadata"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """id, content, metadata as JSON lines, one folder per doc_id; NUL characters go."""
    out = chunks.withColumn("content", F.replace("content", F.lit("\0"), F.lit("")))
    out.repartition("doc_id").write.mode("overwrite").partitionBy("doc_id").json(path)


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of PDF files under a folder, one row each; decode pages with a pandas function of your own."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path).select("path", "content").dropDuplicates(["path"])


def recent_filings(submissions: DataFrame) -> DataFrame:
    """Rows of struct-of-arrays submissions: as many as the shortest of four arrays; reportDate is padded with null."""
    r = "filings.recent."
    n = F.least(*[F.size(r + c) for c in ("accessionNumber", "form", "filingDate", "primaryDocument")])
    zipped = F.arrays_zip(*[F.col(r + c).alias(c) for c in ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")])
    return submissions.select(F.posexplode(F.slice(zipped, F.lit(1), n)).alias("pos", "f")).select("f.*")


def pdf_pages(spark: SparkSession, path: str, decode) -> DataFrame:
    """doc_id, page_no, text of PDF files: decode (a function of your own) turns bytes into page texts; footers go.

    A file that can't be decoded has no pages.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    texts = decode(content)
                except Exception:
                    texts = []
                rows += [(name, k, text or "") for k, text in enumerate(texts, 1)]
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "page_no", "text"), r, strict=True)) for r in rows], pa.schema([("path", pa.string()), ("page_no", pa.int64()), ("text", pa.string())]))

    rows = pdf_files(spark, path).mapInArrow(run, "path string, page_no bigint, text string")
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.pdf$", "")
    return rows.select(stem.alias("doc_id"), "page_no", t.strip(t.without_footers(F.col("text"))).alias("text"))


def resolved(asked: DataFrame, tickers: DataFrame) -> DataFrame:
    """asked (ticker) with cik10 and title of the first listed company of that ticker, whatever its case; null if there is none.

    tickers: nth, ticker, cik, title.
    """
    nth = F.row_number().over(Window.partitionBy(F.upper("ticker")).orderBy("nth"))
    known = tickers.withColumn("k", nth).where("k = 1").select(F.upper("ticker").alias("__ticker"), cik10(F.col("cik")).alias("cik10"), "title")
    return asked.join(known, F.upper("ticker") == F.col("__ticker"), "left").drop("__ticker")


def cik10(cik: Column) -> Column:
    """The digits of a company number, ten at least."""
    digits = F.regexp_replace(cik.cast("string"), r"\D", "")
    return F.when(F.length(digits) < 10, F.lpad(digits, 10, "0")).otherwise(digits)


def filing_folder(base: str, cik: Column, accession: Column) -> Column:
    """Where a filing's files stand: the company number without zeros, the accession number without dashes."""
    return F.concat_ws("/", F.lit(base), F.regexp_replace(cik, "^0+(?=.)", ""), F.replace(accession, F.lit("-"), F.lit("")))


def exhibits(indexes: DataFrame) -> DataFrame:
    """accession, name of the exhibit-10 files in filings' indexes (accession, directory.item)."""
    rows = indexes.select("accession", F.explode("directory.item.name").alias("name"))
    return rows.where(is_exhibit10(F.col("name")))


def is_exhibit10(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(htm|html|txt|pdf)$") & F.lower(name).rlike("ex[-_ ]?10|ex10")


def add_messages(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Append messages (conv_id, role, content, created_at) to a table of conversations."""
    rows.select("conv_id", "role", "content", F.greatest(F.lit(1), F.floor(F.length("content") / 4)).alias("tokens"), "created_at").write.mode("append").parquet(f"{path}/messages")


def set_summaries(path: str, rows: DataFrame) -> None:
    """Append summaries (conv_id, summary, updated_at); the latest one counts."""
    rows.select("conv_id", "summary", "updated_at").write.mode("append").parquet(f"{path}/conversations")


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, summary: the latest of each conversation."""
    return spark.read.parquet(f"{path}/conversations").groupBy("conv_id").agg(F.max_by("summary", "updated_at").alias("summary"))
