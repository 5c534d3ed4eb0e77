"""Clip, corpus, voice and cache files written by the tests and read by the sources."""

from __future__ import annotations

import csv
import io
import json
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonaria.functions import codec, text
from sonaria.operators import catalog, dataset
from sonaria.sources import audio, corpus, records, sinks, voices


def wav_bytes(x, rate):
    x = np.atleast_2d(np.asarray(x))
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as f:
        f.setnchannels(len(x))
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").T.tobytes())
    return buffer.getvalue()


def sine(rate, seconds, freq=440.0, amp=0.5):
    return amp * np.sin(2 * np.pi * freq * np.arange(int(rate * seconds)) / rate)


@pytest.fixture(scope="module")
def clips(tmp_path_factory):
    root = tmp_path_factory.mktemp("clips")
    (root / "deep").mkdir()
    left = sine(44100, 0.3, amp=0.8)
    (root / "stereo.wav").write_bytes(wav_bytes([left, np.zeros_like(left)], 44100))
    (root / "deep" / "mono48.wav").write_bytes(wav_bytes(sine(48000, 0.2), 48000))
    (root / "deep" / "mono8.wav").write_bytes(wav_bytes(sine(8000, 0.2), 8000))
    (root / "same.wav").write_bytes(wav_bytes(sine(16000, 0.1), 16000))
    (root / "bad.wav").write_bytes(b"RIFF nothing")
    (root / "song.mp3").write_bytes(b"ID3")
    (root / "UPPER.WAV").write_bytes(wav_bytes(sine(16000, 0.1), 16000))
    (root / "note.txt").write_text("x")
    return str(root)


def test_listing_is_recursive_and_case_sensitive(spark, clips):
    listed = audio.list_audio(spark, clips)
    names = {r.path.rsplit("/", 1)[1] for r in listed.collect()}
    assert names == {"stereo.wav", "mono48.wav", "mono8.wav", "same.wav", "bad.wav", "song.mp3"}
    assert listed.columns == ["path", "length"]


def test_decoded_clips(spark, clips):
    rows = {r.path.rsplit("/", 1)[1]: r for r in audio.read_clips(spark, clips).collect()}
    stereo = rows["stereo.wav"]
    assert abs(len(stereo.samples) - 4800) <= 2 and 0.25 <= max(stereo.samples) <= 0.6
    assert abs(len(rows["mono48.wav"].samples) - 3200) <= 2
    assert abs(len(rows["mono8.wav"].samples) - 3200) <= 2
    assert len(rows["same.wav"].samples) == 1600 and rows["same.wav"].sample_rate == 16000
    assert rows["bad.wav"].samples is None and rows["bad.wav"].error.startswith("unsupported")
    assert rows["song.mp3"].error.startswith("unsupported")


def test_pcm16_round_trip(spark):
    rows = [(0, [0.5, -0.5, float("nan"), 2.0, float("-inf")])]
    df = spark.createDataFrame(rows, "i int, x array<double>").withColumn("b", codec.encode_pcm16(F.col("x")))
    out = df.select(
        codec.decode_pcm16(F.col("b")).alias("service"), codec.decode_pcm16(F.col("b"), scale=32768).alias("buffer")
    ).first()
    ints = [16383, -16383, 0, 32767, -32767]
    assert out.service == pytest.approx([v / 32767 for v in ints])
    assert out.buffer == pytest.approx([v / 32768 for v in ints])


def test_metadata_quoting_and_done_set(spark, tmp_path):
    path = str(tmp_path / "meta")
    rows = [("Dir/A.wav", 'say "hi" | there'), ("b.WAV", "two\nlines"), ("c.wav", "")]
    sinks.append_metadata(spark.createDataFrame(rows, "file string, text string"), path)
    sinks.append_metadata(spark.createDataFrame([("d.wav", " kept ")], "file string, text string"), path)
    read = corpus.read_metadata(spark, path)
    assert {(r.file, r.text) for r in read.collect()} == set(rows) | {("d.wav", " kept ")}
    assert {r.done_key for r in dataset.done_keys(read).collect()} == {"a.wav", "b.wav", "c.wav", "d.wav"}
    clips = spark.createDataFrame([("x/a.WAV",), ("y/new.wav",)], "path string")
    assert [r.path for r in dataset.todo(clips, read).collect()] == ["y/new.wav"]
    assert dataset.todo(clips, read, full_path=True).count() == 2


def test_plain_lines_keep_pipes_in_the_text(spark, tmp_path):
    path = str(tmp_path / "raw")
    sinks.append_raw_metadata(spark.createDataFrame([("a.wav", 'x|"y"')], "file string, text string"), path)
    assert [(r.file, r.text) for r in corpus.read_raw_metadata(spark, path).collect()] == [("a.wav", 'x|"y"')]


def test_tsv_splits_dedup_in_file_order(spark, tmp_path):
    head = "client_id\tpath\tsentence\textra\n"
    (tmp_path / "train.tsv").write_text(
        head + 'c\ta.mp3\t"quoted ""one"""\t\nc\tb.mp3\tfirst\t\nc\tb.mp3\t second \t\nc\tgone.mp3\tx\t\n', encoding="utf-8"
    )
    (tmp_path / "test.tsv").write_text(head + "c\ta.mp3\tlate\t\nc\tc.mp3\t\t\nc\td.mp3\t   \t\n", encoding="utf-8")
    read = corpus.read_tsv_splits(spark, str(tmp_path), ["train.tsv", "dev.tsv", "test.tsv"])
    clips = spark.createDataFrame([("a.mp3",), ("b.mp3",), ("c.mp3",), ("d.mp3",)], "path string")
    kept = dataset.last_wins(dataset.usable_rows(read, clips), "path", corpus.FILE_ORDER)
    assert {(r.path, r.text) for r in kept.collect()} == {("a.mp3", "late"), ("b.mp3", "second"), ("d.mp3", "")}
    assert corpus.read_tsv_splits(spark, str(tmp_path), ["none.tsv"]).count() == 0


def test_stable_index_over_many_partitions(spark):
    rows = spark.range(5000).select(F.format_string("p%05d", 4999 - F.col("id")).alias("path")).repartition(16)
    got = dataset.stable_index(rows, ["path"]).collect()
    assert all(int(r.path[1:]) == r.idx for r in got) and len(got) == 5000


def test_resume_point_and_batches(spark):
    rows = spark.range(200).select(F.col("id").alias("idx"))
    start = dataset.resume_start(F.lit(70), F.lit(65), F.lit(200))
    batched = dataset.batches(rows, start)
    sizes = {r.batch: r["count"] for r in batched.groupBy("batch").count().collect()}
    assert sizes == {0: 64, 1: 64, 2: 2}
    assert batched.agg(F.min("wav_name")).first()[0] == "cv_0000070.wav"
    assert dataset.progress_after(rows.limit(0)).first().progress == 0


def test_run_report_lasts_at_least_a_second(spark):
    rows = spark.createDataFrame([(None, 0), ("x", 10), (None, 20)], "error string, ts_us long")
    r = dataset.run_report(rows).first()
    assert (r.n_ok, r.n_bad, r.rows_per_sec) == (2, 1, 3.0)


def test_voice_folders_and_caches(spark, tmp_path):
    root = tmp_path / "voices"
    for name in ("v1", "v2"):
        (root / name).mkdir(parents=True)
    meta = {"voice_id": "v1", "sr": 24000, "orig_file": "in.wav", "ref_text": "hello"}
    (root / "v1" / "meta.json").write_text(json.dumps(meta, indent=2))
    ids = spark.createDataFrame([("v1",), ("v2",)], "voice_id string")
    got = {r.voice_id: (r.sr, r.orig_file, r.ref_text) for r in voices.read_voices(spark, str(root), ids).collect()}
    assert got == {"v1": (24000, "in.wav", "hello"), "v2": (0, "", "")}
    written = spark.createDataFrame([("v3", 16000, "x.wav", "one\ntwo")], voices.META_SCHEMA)
    more = ids.unionByName(spark.createDataFrame([("v3",)], "voice_id string"))
    for write, read in ((sinks.write_voices, voices.read_voices), (sinks.write_voice_table, voices.read_voice_table)):
        folder = str(tmp_path / write.__name__)
        write(written, folder)
        back = {r.voice_id: (r.sr, r.ref_text) for r in read(spark, folder, more).collect()}
        assert back == {"v1": (0, ""), "v2": (0, ""), "v3": (16000, "one\ntwo")}


def test_cache_documents_are_imported(spark, tmp_path):
    stored = {"by_sha1": {"s1": "one"}, "by_path": {"a/b.wav": "one", "c.wav": "two"}}
    (tmp_path / "cache.json").write_text(json.dumps(stored, indent=2))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "half.json").write_text(json.dumps({"by_sha1": {"s2": "x"}}))
    entries = {tuple(r) for r in voices.import_cache(spark, str(tmp_path / "cache.json")).collect()}
    assert entries == {("by_sha1", "s1", "one"), ("by_path", "a/b.wav", "one"), ("by_path", "c.wav", "two")}
    assert voices.import_cache(spark, str(tmp_path / "broken.json")).count() == 0
    assert [tuple(r) for r in voices.import_cache(spark, str(tmp_path / "half.json")).collect()] == [("by_sha1", "s2", "x")]


def test_cache_table_reads_what_it_wrote(spark, tmp_path):
    root, schema = str(tmp_path / "cache"), "kind string, key string, text string"

    def entries():
        return {(r.kind, r.key): r.text for r in voices.read_cache(spark, root).collect()}

    assert entries() == {}
    rows = [("by_sha1", "a", "1"), ("by_path", "a", "p"), ("by_sha1", "b", "2"), ("by_sha1", "b", "3")]
    assert sinks.write_cache(spark.createDataFrame(rows, schema), root) == 0
    assert sinks.write_cache(spark.createDataFrame([("by_sha1", "a", "new")], schema), root) == 1
    want = {("by_sha1", "a"): "new", ("by_path", "a"): "p", ("by_sha1", "b"): "3"}
    assert entries() == want
    assert sinks.compact_cache(spark, root) == 2
    assert entries() == want and voices.cache_entries(spark, root).count() == 3
    sinks.write_cache(spark.createDataFrame([("by_path", "a", "q")], schema), root)
    # A version whose writer did not finish is not there.
    (tmp_path / "cache" / "version-9").mkdir()
    assert entries() == want | {("by_path", "a"): "q"}
    assert {r.sha1 for r in voices.by_sha1(voices.read_cache(spark, root)).collect()} == {"a", "b"}
    assert [tuple(r) for r in voices.by_path(voices.read_cache(spark, root)).collect()] == [("a", "q")]


def test_cache_computes_each_key_once(spark):
    keys = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "sha1 string")
    cache = spark.createDataFrame([("c", "known")], "sha1 string, text string")
    seen = []

    def compute(missing):
        seen.append(missing.count())
        return missing.withColumn("text", F.concat(F.lit("new "), "sha1"))

    texts, fresh = catalog.cached_transcripts(keys, cache, compute)
    assert seen == [2]
    assert {(r.sha1, r.text, r.hit) for r in texts.collect()} == {
        ("a", "new a", False), ("b", "new b", False), ("c", "known", True),
    }
    assert fresh.count() == 2


def test_text_functions(spark):
    df = spark.createDataFrame([(" \t a   b \x1c\n",)], "s string")
    r = df.select(
        text.strip(F.col("s")).alias("strip"),
        text.clean_transcript(F.col("s")).alias("clean"),
        text.truncate_words(F.lit("hello big world"), 9).alias("cut"),
        text.truncate_words(F.lit("helloworld"), 5).alias("hard"),
        text.speech_seconds(F.lit("x")).alias("short"),
        text.suffix(F.lit("a/.hidden")).alias("hidden"),
        text.stem(F.lit("a/b.c.WAV")).alias("stem"),
    ).first()
    assert (r.strip, r.clean, r.cut, r.hard, r.short) == ("a   b", "a  b", "hello", "hello", 1.0)
    assert (r.hidden, r.stem) == ("", "b.c")


def test_all_labels(spark):
    labels = text.label_table(spark)
    assert labels.count() == 33
    rows = labels.select("label", text.labelled_token(F.lit("sLOVO"), F.col("label")).alias("t")).collect()
    got = {r.label: r.t for r in rows}
    assert got["LOWER_O"] == "sLOVO" and got["UPPER_COMMA"] == "Slovo," and got["UPPER_TOTAL_QUESTIONVOSKL"] == "SLOVO?!"
    assert got["LOWER_TIRE"] == "sLOVO—" and got["UPPER_TIRE"] == "Slovo —" and got["UPPER_TOTAL_TIRE"] == "SLOVO —"
    unknown = spark.range(1).select(text.labelled_token(F.lit("a"), F.lit("MIXED_O")).alias("t"))
    assert unknown.first().t is None
    odd = spark.range(1).select(text.labelled_token(F.lit("a"), F.lit("UPPER_ODD")).alias("t"))
    assert odd.first().t is None


FIELDS = ["plain", "", "two\nlines", 'say "hi"', '"', "a|b\tc", "\n\n", 'x"y', "tail\\", '""', "é ü", "many\n" * 40]


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_records_cross_splits_and_lines(spark, tmp_path, small_splits, line_end):
    """A file is many tasks; what Python's reader makes of it as a whole is what comes out."""
    rng = np.random.default_rng(4)
    rows = [[str(i), *rng.choice(FIELDS, 2).tolist()] for i in range(400)]
    for name, part in (("a.tsv", rows[:250]), ("b.tsv", rows[250:])):
        with open(tmp_path / name, "w", encoding="utf-8", newline="") as f:
            out = csv.writer(f, delimiter="\t", lineterminator=line_end)
            out.writerow(["client_id", "path", "sentence"])
            out.writerows([r[0], f"p{r[0]}", r[1] + r[2]] for r in part)
            # A quote inside a field that does not begin with one is a character like any other.
            f.write(f"s\tstray{name}\tfive 5\" pipes{line_end}")
    read = corpus.read_tsv_splits(spark, str(tmp_path), ["a.tsv", "b.tsv"])
    assert read.rdd.getNumPartitions() > 4
    got = read.orderBy("file_rank", "block_start", "row_id").collect()
    assert {r.file_name for r in got} == {"a.tsv", "b.tsv"}
    assert len({r.block_start for r in got}) > 10
    wanted = []
    for name in ("a.tsv", "b.tsv"):
        with open(tmp_path / name, encoding="utf-8", newline="") as f:
            wanted += [(r["path"], r["sentence"]) for r in csv.DictReader(f, delimiter="\t")]
    assert [(r.path, r.sentence or "") for r in got] == wanted


def test_metadata_crosses_splits(spark, tmp_path, small_splits):
    rng = np.random.default_rng(5)
    rows = [(f"{i}.wav", "".join(rng.choice(FIELDS, 3))) for i in range(300)]
    path = str(tmp_path / "meta")
    sinks.append_metadata(spark.createDataFrame(rows, "file string, text string").coalesce(1), path)
    assert sorted((r.file, r.text) for r in corpus.read_metadata(spark, path).collect()) == sorted(rows)


def test_files_with_other_headers_are_refused(spark, tmp_path):
    folder = tmp_path / "split"
    folder.mkdir()
    (folder / "a.tsv").write_text("path\tsentence\nx\ty\n")
    (folder / "b.tsv").write_text("sentence\tpath\nx\ty\n")
    with pytest.raises(Exception, match="headers differ"):
        corpus.read_tsv_splits(spark, str(tmp_path), ["split"]).collect()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab"\t\n', max_size=6), min_size=2, max_size=3), max_size=6))
def test_line_states_follow_the_reader(rows):
    """Lines of written records begin inside a field exactly where the writer broke one."""
    inside, ends = False, []
    for row in rows:
        buffer = io.StringIO()
        csv.writer(buffer, delimiter="\t", lineterminator="").writerow(row)
        lines = buffer.getvalue().split("\n")
        for line in lines:
            inside = records.ends_inside(line, inside, "\t")
            ends.append(inside)
        assert ends[-len(lines) :] == [True] * (len(lines) - 1) + [False]
