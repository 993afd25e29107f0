"""Kinetics of dialogues, kept up to date as files of turns arrive.

A dialogue is a trajectory, a turn a frame. Its state is the speaker's role
and whether the turn is short or long; its weight is its number of words. A
file stream takes only the files that its checkpoint does not know, writes

* ``<output>/turns``: state and weight of each turn, by batch and span of dialogue ids,
* ``<output>/counts``: lag counts and populations of each span, of which a batch rewrites those it touches,
* ``<output>/report``: by lag, the counts and transition probabilities over everything seen so far.

A batch that is run again after a failure rewrites the same partitions, so
nothing is counted twice. A turn that comes again, in the same file or a
later one, replaces the earlier; late turns of an old dialogue are put in
their place, since its span is counted anew.

    python -m jobs.dialogue_flow --input turns/ --output out --checkpoint marks [--config dialogue_flow.json]
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, new_folder, replace_table, shipped_config
from lagwell.operators.counting import count_matrix
from lagwell.operators.frames import number_rows
from lagwell.operators.lag import halo_pairs
from lagwell.plans.lineage import file_system

SCHEMA = "conv_id long, turn long, role string, text string"
TURNS = "traj_id long, frame long, state int, weight double, tie long, batch long, span long"
COUNTS = "lag int, i int, j int, count double, n_pairs long, span long"
#: Spans that a batch may touch and still have the others' files left unread.
MOST_NAMED = 5000
WORD = r"[^\x20\x09-\x0D]+"


def turn_state(config: dict) -> tuple[Column, Column]:
    """``(state, weight)``: twice the role's place, one more for long turns, -1 for other roles; the words of the text."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    place = F.array_position(F.array(*(F.lit(r) for r in config["roles"])), F.col("role")).cast("int") - 1
    state = F.when(place >= 0, 2 * place + (words >= config["long_from_words"]).cast("int"))
    return F.coalesce(state, F.lit(-1)), words.cast("double")


def _write(df: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that ``df`` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def latest_turns(turns: DataFrame) -> DataFrame:
    """One row for each (dialogue, turn): of the last batch, and of the greatest hash within it. Turns without a number, which come first, are one only where role and text agree."""
    newest = F.max_by(F.struct("state", "weight"), F.struct("batch", "tie"))
    nameless = F.when(F.col("frame").isNull(), F.col("tie")).alias("nameless")
    return turns.groupBy("span", "traj_id", "frame", nameless).agg(newest.alias("kept")).select("span", "traj_id", "frame", "nameless", "kept.*")


def span_counts(turns: DataFrame, lags: list[int]) -> DataFrame:
    """``(lag, i, j, count, n_pairs, span)``: lag pairs, and at lag 0 the weight and turns of every state, -1 included."""
    numbered = number_rows(latest_turns(turns), ["traj_id", "frame", "nameless"])
    pairs = count_matrix(halo_pairs(numbered, lags, ["state"]), by=("lag", "span"))
    held = numbered.groupBy("span", F.col("state").alias("i")).agg(F.sum("weight").alias("count"), F.count("*").alias("n_pairs"))
    columns = ["lag", "i", "j", "count", "n_pairs", "span"]
    return held.select(F.lit(0).alias("lag"), "i", F.col("i").alias("j"), "count", "n_pairs", "span").union(pairs.select(*columns))


def take_batch(batch: DataFrame, batch_id: int, output_path: str, config: dict) -> int:
    """Write the batch's turns, then count anew the spans that it touches; returns how many turns it wrote."""
    spark = batch.sparkSession
    at = {name: f"{output_path}/{name}" for name in ("turns", "counts")}
    state, weight = turn_state(config)
    tie = F.xxhash64("role", "text")
    span = F.floor(F.col("conv_id") / config["span"]).cast("long")
    rows = batch.where("conv_id is not null").select(F.col("conv_id").alias("traj_id"), F.col("turn").alias("frame"), state.alias("state"), weight.alias("weight"), tie.alias("tie"), F.lit(batch_id).cast("long").alias("batch"), span.alias("span"))
    _write(rows, at["turns"], "batch", "span")
    every = spark.read.schema(TURNS).parquet(at["turns"])
    new = every.where(F.col("batch") == batch_id)
    touched = new.select("span").distinct()
    named = [r["span"] for r in touched.limit(MOST_NAMED + 1).collect()]
    n = new.count()
    log.info("batch %d: %d turns, %s spans", batch_id, n, len(named) if len(named) <= MOST_NAMED else "many")
    mine = every.where(F.col("span").isin(named)) if len(named) <= MOST_NAMED else every.join(touched, "span", "left_semi")
    _write(span_counts(mine, config["lags"]).repartition("span"), at["counts"], "span")
    return n


def report(counts: DataFrame) -> DataFrame:
    """``(lag, i, j, n_pairs, count, p)`` over all spans; at lag 0, ``p`` is the state's share of the labelled weight."""
    total = counts.groupBy("lag", "i", "j").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("count").alias("count"))
    row = F.when(F.col("lag") > 0, F.col("i")).otherwise(-2)
    mass = total.where("i >= 0").groupBy("lag", row.alias("row")).agg(F.sum("count").alias("mass"))
    shared = total.withColumn("row", row).join(mass, ["lag", "row"], "left")
    p = F.when((F.col("i") >= 0) & (F.col("mass") > 0), F.col("count") / F.col("mass"))
    return shared.select("lag", "i", "j", "n_pairs", "count", p.alias("p"))


def there(spark: SparkSession, path: str) -> bool:
    name, files = file_system(spark, path)
    return files.exists(name)


def as_pattern(path: str) -> str:
    """A pattern that matches the path alone: a file stream takes a plain path for a folder, a pattern for a file too."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, input_path: str, output_path: str, checkpoint_path: str, config: dict) -> dict:
    """Take the files that are new, wait until they are done, write the report; returns what was read and written."""
    out = output_path.rstrip("/")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(as_pattern(input_path))
    sizes: list[int] = []
    held = stream.writeStream.option("checkpointLocation", checkpoint_path).trigger(availableNow=True).foreachBatch(lambda df, k: sizes.append(take_batch(df, k, out, config))).start()
    held.awaitTermination()
    taken = sum(sizes)
    log.info("read %d new rows of %s", taken, input_path)
    seen = spark.read.schema(COUNTS).parquet(f"{out}/counts") if there(spark, f"{out}/counts") else spark.createDataFrame([], COUNTS)
    return {"new_rows": taken, "report": replace_table(report(seen).coalesce(1), f"{out}/report", "lag")[1]}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over the whole of ``conversations``, after two runs into one folder with one checkpoint."""
    out, config = new_folder(spark, "dialogue_flow"), shipped_config(__file__)
    for _ in range(2):
        run(spark, f"{sf_dir}/conversations.parquet", f"{out}/output", f"{out}/marks", config)
    found = spark.read.parquet(f"{out}/output/report")
    return found.select("lag", "i", "j", "n_pairs", "count", F.round("p", 6).alias("p"))


SQL = r"""
with w as (select conv_id, turn, role, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) words from conversations where conv_id is not null),
f as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) pos, words::double weight,
  case role when 'system' then 0 when 'user' then 2 when 'assistant' then 4 else null end + (words >= 40)::int s from w),
g as (select conv_id, pos, weight, coalesce(s, -1) state from f),
c as (select 0 lag, state i, state j, sum(weight) as count, count(*) n_pairs from g group by all
  union all select l.lag, a.state, b.state, sum(a.weight), count(*) from g a cross join (select unnest([1, 2]) lag) l join g b on b.conv_id = a.conv_id and b.pos = a.pos + l.lag
  where a.state >= 0 and b.state >= 0 and a.weight > 0 group by all),
m as (select *, sum(case when i >= 0 then count end) over (partition by lag, case when lag > 0 then i else -2 end) mass from c)
select cast(lag as int) lag, cast(i as int) i, cast(j as int) j, n_pairs, count, case when i >= 0 and mass > 0 then round(count / mass, 6) end p from m
"""

if __name__ == "__main__":
    main(run, __file__, "Kinetics of dialogues, kept up to date as files arrive", ("input", "output", "checkpoint"))
