"""Corpus pipeline over ``documents``, written and reread stage by stage.

1. toxicity: documents scored 0.5 or more are dropped;
2. near_duplicates: one document of each near-duplicate class stays (5-word
   shingles, similarity 0.8 or more; the smallest id);
3. substrings: passages that an earlier document also holds are cut;
4. mixing: documents are dealt in the order of the mix; sources that are rarer
   than their target weight start over, so the weights hold over the whole
   output and nothing is dropped;
5. pieces: every document's token ids with the source span of each, and its
   ``position`` in the mix.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  Extra columns pass through, whatever
their names.  Null and empty texts, repeated rows and empty tables are handled
as the operators state; rows that repeat an id and its text leave one row at
stage 2, different texts of one id are documents of their own there, rows without
an id all stay.

A table of documents has no place for the order of the mix but its files: the
mixing stage returns its rows sorted, they are written file by file in that
order, and the last stage reads every row's file and place in it back.
"""

import contextlib
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfsense.llm import minhash, mixing, pieces, substring, toxicity
from shelfsense.llm._common import Scratch
from shelfsense.llm.registry import piece_model


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Inner tables of the stage that ``run`` has under way.
_open: list[list[Scratch]] = []


def _scratch(spark, name):
    made = Scratch(spark, name)
    if _open:
        _open[-1].append(made)
    return made


@contextlib.contextmanager
def _inner_tables():
    """Drops the inner tables made inside, once what was built on them is written."""
    _open.append([])
    try:
        yield
    finally:
        for made in _open.pop():
            made.drop()


def extras_aside(stage):
    """Carries columns beyond COLUMNS through a stage as one struct, so none can
    clash with a name the stage uses."""

    @wraps(stage)
    def wrapped(spark, docs, sf_dir):
        extras = [c for c in docs.columns if c not in COLUMNS]
        if not extras:
            return stage(spark, docs, sf_dir)
        packed = docs.select(*COLUMNS, F.struct(*[F.col(f"`{c}`") for c in extras]).alias("__extras"))
        return stage(spark, packed, sf_dir).select(
            *[F.col(c) if c in COLUMNS else F.col("__extras")[c].alias(c) for c in docs.columns])

    return wrapped


@extras_aside
def drop_toxic(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, _scratch(spark, "toxicity"))
    return toxicity.score_documents(docs, model).where("predicted = 0").select(docs.columns)


def _own_ids(docs, scratch):
    """``docs`` with ``__node``: the id, or a new number beyond all ids for the
    second and further texts of an id that stands for several."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.where("doc_id is not null").select("doc_id", text.alias("__h"))
    several = texts.groupBy("doc_id").agg(F.min("__h").alias("least"), F.max("__h").alias("most")).where("least < most")
    more = texts.join(several, "doc_id").where("__h <> least").select("doc_id", "__h").distinct()
    last = F.lit(docs.agg(F.max("doc_id")).first()[0] or 0)
    more = scratch.save(more.withColumn("__more", last + 1 + F.monotonically_increasing_id()), "further-texts")
    return (docs.withColumn("__h", text).join(more, ["doc_id", "__h"], "left")
            .select(*docs.columns, F.coalesce("__more", "doc_id").alias("__node")))


@extras_aside
def keep_one_of_each_class(spark, docs, sf_dir):
    scratch = _scratch(spark, "minhash")
    named = _own_ids(docs, scratch)
    found = minhash.near_duplicates(named.select(F.col("__node").alias("doc_id"), "text"), scratch, k=5)
    gone = found.where("not kept").select(F.col("doc_id").alias("__node")).distinct()
    rows = Window.partitionBy("__node", F.when(F.col("__node").isNull(), F.xxhash64("text"))).orderBy(F.xxhash64("text"))
    return (named.join(gone, "__node", "left_anti").withColumn("__row", F.row_number().over(rows))
            .where("__row = 1 or __node is null").select(docs.columns))


@extras_aside
def cut_repeated_passages(spark, docs, sf_dir):
    cut = substring.cut_repeats(docs, scratch=_scratch(spark, "substring"))
    return cut.withColumn("n_chars", F.when(F.col("has_repeat"), F.length("text").cast("long")).otherwise(
        F.col("n_chars"))).select(docs.columns)


@extras_aside
def mix_sources(spark, docs, sf_dir):
    return mixing.mix(docs).orderBy("position").select(docs.columns)


def _with_position(docs, scratch):
    """``docs`` with ``position``: the row's place among all rows, in the order of
    their files; null where ``docs`` does not come from files."""
    try:
        rows = docs.withColumns({"__file": F.col("_metadata.file_name"), "__at": F.col("_metadata.row_index")})
    except AnalysisException:
        return docs.withColumn("position", F.lit(None).cast("long"))
    # one row per file
    files = rows.groupBy("__file").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))
    files = scratch.save(files.select(F.col("__file").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before")), "files")
    return rows.join(files, F.col("__file") == F.col("__of")).withColumn("position", F.col("__before") + F.col("__at"))


def encode(spark, docs, sf_dir):
    rows = _with_position(docs.select("doc_id", "source", "text"), _scratch(spark, "order")).select("doc_id", "source", "text", "position")
    made = pieces.encode_documents(rows, pieces.read_model(piece_model()))
    return made.select("doc_id", "source", "position", F.size("ids").alias("n_tokens"), "ids", "span_begins",
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_class),
    ("substrings", cut_repeated_passages),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: MinHash, chunk boundaries and token ids have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; every stage's result is written to the
    shared folder and reread as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with _inner_tables():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
