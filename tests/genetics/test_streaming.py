from kindred.operators import sexbias
from kindred.streaming import batches
from kindred.streaming.ingest import watch


def test_new_files_are_taken_once(spark, tmp_path):
    def put(name, lines):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "a.txt").write_text("".join(f"rs{k}\t1\t{k}\tAG\t0.9\t0.5\t0.1\n" for k in lines))

    def run():
        watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out/rows")).groupBy("participant_id").count().collect()

    put("p1", [1, 2, 0])
    assert {r[0]: r[1] for r in run()} == {"p1": 2}
    put("p2", [5])
    assert {r[0]: r[1] for r in run()} == {"p1": 2, "p2": 1}
    assert spark.read.parquet(str(tmp_path / "out/issues")).count() == 1


def test_batches_merge_as_one_and_may_be_repeated(spark, tmp_path):
    rows = [(f"s{k}", c, p, f"rs{c}{p}", ("AG", "AA", "--", "GG")[(k + p) % 4], 0.5 + k / 100) for k in range(9) for c in ("1", "2", "X") for p in range(1, 6)]
    g = spark.createDataFrame(rows, "sample_id string, chrom string, pos long, rsid string, gt string, gs double")
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(batches.partial_counts(sexbias.signals(g))), key(sexbias.chromosome_stats(g))
    folder = str(tmp_path / "by_hand")
    for k in (0, 1, 2, 0, 2):
        batches.write_batch(g.where(f"cast(substr(sample_id, 2) as int) % 3 = {k}"), f"b{k}", folder)
    assert tuple(map(key, batches.merged(spark, folder))) == want
    for k in range(3):
        g.where(f"cast(substr(sample_id, 2) as int) % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(g.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batches.watch_genotypes(stream, str(tmp_path / "streamed"), str(tmp_path / "check")).awaitTermination()
    assert len(list((tmp_path / "streamed/counts").iterdir())) == 3
    assert tuple(map(key, batches.merged(spark, str(tmp_path / "streamed")))) == want
