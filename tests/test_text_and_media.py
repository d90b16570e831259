import numpy as np
import pytest
from pyspark.sql import functions as F

from cleaveset.functions import text as fn
from cleaveset.operators import audio, embedders, image, text
from cleaveset.sources import files, generators
from cleaveset.streaming import scorers


def order(df):
    return [r.id for r in sorted(df.collect(), key=lambda r: r.pos)]


def scores(df):
    return {r.id: r.score for r in df.collect()}


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string")


def test_tokens(spark):
    df = texts(spark, "hello world", "hello   world", "", "hello", "a b")
    assert [r.n for r in df.select(F.size(fn.simple_tokenizer(F.col("text"))).alias("n")).collect()] == [2, 2, 0, 1, 2]
    assert order(text.tokens_length(texts(spark, "one", "one two three four", "one two"))) == [0, 2, 1]
    assert scores(text.tokens_length(texts(spark, "a,b,c", "a,b"), tokenizer=lambda c: F.split(c, ","))) == {0: 3, 1: 2}
    assert order(text.character_length(texts(spark, "greetings", "hi", "hello"), short_first=False)) == [0, 2, 1]


def test_diversity_rarity_sentences(spark):
    df = texts(spark, "the the the the", "the cat sat mat", "the cat the cat", "")
    assert scores(text.lexical_diversity(df)) == {0: 0.25, 1: 1.0, 2: 0.5, 3: 0.0}
    table = spark.createDataFrame([("the", 0.05), ("a", 0.02), ("is", 0.01)], "word string, frequency double")
    rare = texts(spark, "the a is", "photosynthesis mitochondria", "")
    got = scores(text.vocabulary_rarity(rare, table))
    assert got[2] == 0 and got[1] == 1 and got[0] < 1
    assert scores(text.sentence_count(texts(spark, "One.", "One. Two here.", "A b. C d! E f? G h."))) == {0: 1, 1: 2, 2: 4}


def test_readability(spark):
    easy, hard = "The cat sat. The dog ran. We had fun. " * 12, "Notwithstanding considerable organisational complexity, interdisciplinary collaboration facilitates comprehensive understanding. " * 12
    df = texts(spark, easy, hard, "Hi.")
    for metric in fn.READABILITY:
        words = ["the", "cat", "sat", "dog", "ran", "we", "had", "fun"] if metric == "dale_chall" else None
        got = scores(text.readability_score(df, metric, easy_words=words))
        assert got[2] == float("inf")
        if metric == "flesch":
            assert got[0] > got[1]
        elif metric != "smog":
            assert got[0] < got[1]
    with pytest.raises(ValueError):
        text.readability_score(df, "unknown")


def test_similarities(spark):
    df = spark.createDataFrame([("a b c d", "a b c d"), ("a b c", "x y z"), ("a b c d", "a b x d"), ("", "")], "x string, y string")
    got = [r[0] for r in df.select(fn.ngram_jaccard_similarity(F.col("x"), F.col("y"))).collect()]
    assert got[0] == 1 and got[1] == 0 and got[2] == pytest.approx((3 / 5 + 1 / 5 + 0) / 3) and got[3] == 0
    assert [round(r[0], 3) for r in df.select(fn.difflib_token_similarity(F.col("x"), F.col("y"))).collect()] == [1, 0, 0.75, 1]
    pair = texts(spark, "a b c", "x y z")
    assert text.diversity_text(pair, block_rows=1).first().diversity == 0.5


def test_perplexity(spark):
    df = texts(spark, "a b a b a b", "c d e f", "a")
    got = scores(text.bigram_perplexity(df))
    assert got[0] < got[1] and got[2] == float("inf")
    assert scores(text.perplexity_score(df, lambda t: [1.0] * (len(t.split()) - 1)))[2] == float("inf")


def test_images(spark, tmp_path):
    table = generators.image_table(spark)
    pixels = image.to_pixels(table)
    b = scores(image.mean_brightness(pixels))
    assert b["dark"] == 30 and b["bright"] == 230 and b["dark"] < b["medium"] < b["bright"]
    c = scores(image.contrast(pixels))
    assert c["low_contrast"] < c["high_contrast"]
    v = scores(image.color_variance(pixels))
    assert v["grayscale"] == 0 < v["vibrant"]
    f = scores(image.frequency_content(table))
    assert f["smooth"] < f["detailed"]
    z = scores(image.zlib_ratio(table))
    assert z["simple"] > z["complex"]
    d = {r.id: r for r in image.dominant_color(table, target_color=(200, 50, 50)).collect()}
    assert d["red"].score == 0 and list(d["red"].rgb) == [200, 50, 50]
    for k, a in list(generators.named_images().items())[:4]:
        files.write_png(tmp_path / f"{k}.png", a)
    read = scores(image.mean_brightness(image.to_pixels(files.images(spark, str(tmp_path)))))
    assert {round(v) for k, v in read.items() if "dark" in k or "bright" in k} == {30, 230}


def test_audio(spark, tmp_path):
    table = generators.sound_table(spark)
    samples = files.samples(table.where("id in ('quiet', 'medium', 'loud', 'low_zcr', 'high_zcr')"))
    for score in (audio.mean_amplitude, audio.rms_energy):
        s = scores(score(samples))
        assert s["quiet"] < s["medium"] < s["loud"]
    assert scores(audio.dynamic_range(samples))["loud"] > scores(audio.dynamic_range(samples))["quiet"]
    assert scores(audio.zero_crossings(samples))["low_zcr"] < scores(audio.zero_crossings(samples))["high_zcr"]
    for name, low, high in (("spectral_centroid", "dark", "bright"), ("spectral_bandwidth", "narrow", "wide"), ("spectral_rolloff", "dark", "bright"), ("spectral_flatness", "tonal", "noisy"), ("zero_crossing_rate", "low_zcr", "high_zcr"), ("fundamental_frequency", "low_pitch", "high_pitch"), ("mfcc_variance", "stable", "chirp"), ("beat_strength", "weak_beats", "strong_beats"), ("harmonic_ratio", "percussive", "harmonic"), ("zlib_ratio", "incompressible", "compressible"), ("tempo", "slow", "fast")):
        s = scores(audio.spectral(table.where(F.col("id").isin(low, high)), name))
        assert s[low] < s[high], (name, s)
    pitch = scores(audio.spectral(table.where("id in ('low_pitch', 'high_pitch')"), "fundamental_frequency"))
    assert pitch["low_pitch"] == pytest.approx(100, rel=0.05) and pitch["high_pitch"] == pytest.approx(1000, rel=0.05)
    files.write_wav(tmp_path / "x.wav", generators.named_sounds()["mid"])
    r = files.audio(spark, str(tmp_path)).first()
    assert r.sr == 22050 and len(r.y) == 22050 and max(r.y) == pytest.approx(0.5, abs=0.01)
    with pytest.raises(ValueError):
        audio.spectral(table, "unknown")


def test_sources_and_embedders(spark, tmp_path):
    (tmp_path / "q.txt").write_text("one\n\n  two  \n   \nthree\n")
    assert sorted(r.line for r in files.text_lines(spark, str(tmp_path / "q.txt")).collect()) == ["one", "three", "two"]
    for name, make in generators.get_distributions().items():
        assert make(spark, 60).count() == 60, name
    df = texts(spark, "check my balance", "check my balance now", "green apples fall")
    e = embedders.HashingEmbedder().transform(df)
    x = {r.id: np.array(r.e) for r in e.collect()}
    assert x[0] @ x[1] > x[0] @ x[2]
    m = embedders.ModelEmbedder(lambda: lambda values: [[float(len(v)), 1.0] for v in values], "text").transform(df)
    assert {r.id: r.e for r in m.collect()}[0] == [16.0, 1.0]
    assert len(embedders.reduce(e, "pca", 2).first().e) == 2
    with pytest.raises(ValueError):
        embedders.reduce(e, "unknown")


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a a b"), (2, "x y")], "id int, text string").write.parquet(source)
    stream = spark.readStream.schema("id int, text string").parquet(source)
    scored = scorers.row_score(stream, scorers.lexical_diversity())
    q = scored.writeStream.foreachBatch(scorers.split_batches(lambda b, _: b.write.mode("append").parquet(out), 0.5)).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id: (round(r.score, 3), r.split) for r in spark.read.parquet(out).collect()}
    assert got == {1: (0.667, "train"), 2: (1.0, "test")}


def test_rarity_shuffles_only_tokens_of_uncommon_words(spark, monkeypatch):
    from cleaveset.operators import text

    monkeypatch.setattr(text, "COMMON", 2)
    texts = ["a a a b c", "A b b d", "", None, "a e e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    tokens = {i: (t or "").lower().split() for i, t in enumerate(texts)}
    every = [w for t in tokens.values() for w in t]
    want = {i: round(sum(1 - every.count(w) / len(every) for w in t) / len(t), 6) if t else 0.0 for i, t in tokens.items()}
    assert {r.id: r.score for r in text.vocabulary_rarity(df, text.corpus_frequencies(df)).collect()} == want
