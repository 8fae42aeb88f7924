from cadenza.sources import audio
from cadenza.streaming import watch_reports


def test_new_files_are_analysed_once(spark, tmp_path):
    folder, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(audio.encode_wav(audio.click_train(128, 40), 44100))
    (tmp_path / "in" / "b.WAV").write_bytes(b"no")
    watch_reports(spark, folder, out, marks, files_at_once=1).awaitTermination()
    first = {r.path.rsplit("/", 1)[1]: r for r in spark.read.parquet(out).select("path", "tempo.bpm", "error", "batch").collect()}
    assert first["a.wav"].bpm == 128 and first["b.WAV"].error and first["a.wav"].batch != first["b.WAV"].batch
    (tmp_path / "in" / "c.wav").write_bytes(audio.encode_wav(audio.click_train(150, 40), 44100))
    watch_reports(spark, folder, out, marks).awaitTermination()
    rows = spark.read.parquet(out).select("path", "tempo.bpm").collect()
    assert len(rows) == 3 and {r.bpm for r in rows} == {128, 150, None}
