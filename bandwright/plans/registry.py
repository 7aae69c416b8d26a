"""Every query of the engine's operators, with the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bandwright.config import SMALL, EngineConfig
from bandwright.functions import arrays, distances, scales
from bandwright.functions.arrays import rounded
from bandwright.operators import aggregates, catalog, cluster, features, frames, ingest, pairs, radio, signal, similarity, stats
from bandwright.plans import oracle
from bandwright.sources import datasource, files, standins, tables
from bandwright.sources.standins import catalog as parts
from bandwright.sources.standins import day_frames, samples, table, tracks
from bandwright.streaming import framing
from bandwright.streaming import ingest as continuous
from bandwright.streaming import radio as radio_stream

Query = Callable[[SparkSession, str], DataFrame]
#: Parameters of the queries: seeds, search text, list of names, loudness floor, rate at which the stand-in streams count.
SEEDS, TEXT, NAMES, LOUD, RATE = (3, 5, 8), "bl", ("red widget", "no such title", "blue bolt"), 150.0, 44100
#: Text sought in each field.
SOUGHT = {"all": TEXT, "artist": "#1", "album": "ar", "title": TEXT}
#: Bands and bins of the stand-in tracks.
LEGACY_SHAPE = EngineConfig(bands=4, bins=16)
REGISTERED: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        REGISTERED[name] = f, sql
        return f

    return keep


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar(tracks(spark, sf_dir), list(SEEDS), 10, "hellinger")


# Catalog


@register("scan_catalog", oracle.SCAN)
def scan_catalog(spark, d):
    return parts(spark, d).select("track_id", "fname", "title", "artist", "album", "track", "length")


@register("project_display_title", oracle.DISPLAY)
def project_display_title(spark, d):
    return parts(spark, d).select("track_id", catalog.display_title().alias("shown"))


@register("track_pad", oracle.TRACK_PAD)
def track_pad(spark, d):
    return parts(spark, d).select("track_id", catalog.padded(F.col("track")).alias("track"), arrays.mm_ss(F.col("length")).alias("elapsed"))


@register("strip_prefix", oracle.STRIP)
def strip_prefix(spark, d):
    return parts(spark, d).select("track_id", catalog.stripped(catalog.display_title()).alias("title"), catalog.now_playing(F.col("title"), F.col("artist"), F.col("album")).alias("label"))


for _name, _fields in (("all", catalog.ALL), ("artist", catalog.ARTIST), ("album", catalog.ALBUM), ("title", catalog.TITLE)):
    register(f"search_{_name}", oracle.search(_name, SOUGHT[_name]))(lambda spark, d, fields=_fields, text=SOUGHT[_name]: catalog.search(parts(spark, d), text, fields))


@register("browse_tree", oracle.BROWSE)
def browse_tree(spark, d):
    return catalog.browse(parts(spark, d))


@register("lookup_list", oracle.lookup(NAMES))
def lookup_list(spark, d):
    return catalog.lookup(parts(spark, d), list(NAMES))


@register("lookup_path", oracle.LOOKUP_PATH)
def lookup_path(spark, d):
    return catalog.by_path(parts(spark, d), "/parts/7").select("track_id", "title", "artist", "album", "track")


@register("filter_suffix", oracle.SUFFIX)
def filter_suffix(spark, d):
    path = files.local_path(F.col("url"))
    return table(spark, d, "pages").select("page_id", files.extension(path).alias("ext"), files.has_extension(path, ["html"]).alias("exact"), files.has_extension(path, ["html"], prefix=True).alias("prefix")).where("exact or prefix")


@register("path_stem", oracle.STEM)
def path_stem(spark, d):
    return table(spark, d, "pages").select("page_id", files.stem(F.col("url")).alias("stem"))


# Ingest


@register("ingest_antijoin", oracle.ANTIJOIN)
def ingest_antijoin(spark, d):
    return ingest.missing(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@register("ingest_prune", oracle.PRUNE)
def ingest_prune(spark, d):
    return ingest.pruned(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id")


@register("ingest_append", oracle.APPEND)
def ingest_append(spark, d):
    first = table(spark, d, "customer").select(F.col("c_custkey").alias("track_id"), F.col("c_name").alias("title"))
    second = table(spark, d, "supplier").select(F.col("s_suppkey").alias("track_id"), F.col("s_name").alias("title"))
    return ingest.appended(first, second)


@register("list_split", oracle.SPLIT)
def list_split(spark, d):
    return ingest.split(parts(spark, d).select("track_id"), 7)


@register("silent_filter", oracle.SILENT)
def silent_filter(spark, d):
    return frames.loud(day_frames(spark, d, LOUD)).select("track_id", "frame_no", rounded(arrays.total(F.col("bands"))).alias("total"))


@register("min_evidence", oracle.MIN_EVIDENCE)
def min_evidence(spark, d):
    return frames.enough(day_frames(spark, d, LOUD), SMALL.min_frames)


@register("histogram_counts", oracle.HIST_COUNTS)
def histogram_counts(spark, d):
    return frames.histogram_counts(day_frames(spark, d, LOUD), SMALL.bins)


@register("histogram_norm", oracle.HIST_NORM)
def histogram_norm(spark, d):
    return frames.histograms(day_frames(spark, d, LOUD), SMALL.bins, SMALL.min_frames).withColumn("p", rounded(F.col("p")))


@register("frame_rate_avg", oracle.RATE_AVG)
def frame_rate_avg(spark, d):
    e = table(spark, d, "events")
    return frames.mean_rate(e.select(F.col("user_id").alias("track_id"), F.floor(F.col("value") * 100).cast("long").alias("frate"), F.length("props").cast("long").alias("length")))


# Distances and similarity

for _name in distances.REGISTRY:
    register(f"dist_{_name}", oracle.distance(_name, SEEDS))(
        lambda spark, d, name=_name: similarity.seed_distances(tracks(spark, d), list(SEEDS), name).select("seed_id", "track_id", rounded(F.col("dist")).alias("dist"))
    )
    register(f"similar_{_name}", oracle.similar(_name, SEEDS))(
        lambda spark, d, name=_name: similarity.similar(tracks(spark, d), list(SEEDS), 10, name).withColumn("distance", rounded(F.col("distance")))
    )


@register("similar_report", oracle.SIMILAR_REPORT)
def similar_report(spark, d):
    return similarity.report(similarity.similar(tracks(spark, d), list(SEEDS), 10), parts(spark, d))


@register("distance_list", oracle.distance_list())
def distance_list(spark, d):
    return distances.listing(spark).select("id", "name")


@register("pairs_matrix", oracle.PAIRS)
def pairs_matrix(spark, d):
    return pairs.triangle(tracks(spark, d)).select("i", "j", arrays.pair_index(F.col("i"), F.col("j")).alias("k"), rounded(F.col("dist")).alias("dist"))


@register("pairs_sorted", oracle.PAIRS_SORTED)
def pairs_sorted(spark, d):
    return pairs.ordered(pairs.triangle(tracks(spark, d), "euclidean").select("i", "j", rounded(F.col("dist")).alias("dist")))


@register("matrix_full", oracle.MATRIX)
def matrix_full(spark, d):
    t = tracks(spark, d)
    return pairs.mirrored(pairs.triangle(t).select("i", "j", rounded(F.col("dist")).alias("dist")), t)


# Frames and spectra


def _power(spark, d):
    return frames.dft_power(samples(spark, d), SMALL.window, SMALL.step)


@register("framing", oracle.FRAMING)
def framing_(spark, d):
    f = frames.framed(samples(spark, d), SMALL.window, SMALL.step)
    return f.groupBy("track_id", "frame_no").agg(F.count("*").alias("n"), rounded(F.sum("value")).alias("total"), rounded(F.sum(F.col("value") * F.col("k"))).alias("moment"))


@register("hann", oracle.HANN)
def hann(spark, d):
    f = frames.framed(samples(spark, d), SMALL.window, SMALL.step)
    return f.groupBy("track_id", "frame_no").agg(rounded(F.sum(F.col("value") * frames.hann(F.col("k"), SMALL.window))).alias("weighted"))


@register("dft_power", oracle.DFT_POWER)
def dft_power(spark, d):
    return _power(spark, d).withColumn("power", rounded(F.col("power"), 3))


@register("fft_numpy", oracle.DFT_POWER)
def fft_numpy(spark, d):
    return frames.rfft_power(samples(spark, d), SMALL.window, SMALL.step).withColumn("power", rounded(F.col("power"), 3))


@register("band_power", oracle.band_power(False, RATE))
def band_power(spark, d):
    return frames.band_power(_power(spark, d), SMALL.window, RATE, 4, weighted=False).withColumn("value", rounded(F.col("value"), 4))


@register("loudness_weighted", oracle.band_power(True, RATE))
def loudness_weighted(spark, d):
    return frames.band_power(_power(spark, d), SMALL.window, RATE, 4).withColumn("value", rounded(F.col("value"), 4))


@register("cepstrum", oracle.cepstrum(RATE))
def cepstrum(spark, d):
    return frames.cepstrum(_power(spark, d), SMALL.window, RATE, 4).withColumn("value", rounded(F.col("value"), 4))


for _name in scales.TO_SCALE:
    register(f"band_edges_{_name}", oracle.band_edges(_name))(
        lambda spark, d, name=_name: spark.createDataFrame([(i, e) for i, e in enumerate(scales.band_edges(24, name))], "band int, edge int")
    )


@register("weights", oracle.WEIGHTS)
def weights(spark, d):
    edges = scales.band_edges(24, "mel")
    return spark.createDataFrame(list(enumerate(scales.loudness_weights(edges))), "band int, weight double").withColumn("weight", rounded(F.col("weight")))


# Statistics


@register("band_stats", oracle.BAND_STATS)
def band_stats(spark, d):
    out = stats.band_stats(day_frames(spark, d))
    return out.select("band", *(rounded(F.col(c)).alias(c) for c in out.columns[1:]))


def _means(spark, d):
    return stats.self_means(day_frames(spark, d))


@register("selfsim", oracle.SELFSIM)
def selfsim(spark, d):
    return stats.self_similarity(day_frames(spark, d)).withColumn("dist", rounded(F.col("dist")))


@register("selfsim_rowmean", oracle.ROWMEAN)
def selfsim_rowmean(spark, d):
    return _means(spark, d).withColumn("mean", rounded(F.col("mean")))


@register("smooth_forward", oracle.SMOOTH)
def smooth_forward(spark, d):
    return stats.smoothed(_means(spark, d), share=10).withColumn("smooth", rounded(F.col("smooth")))


@register("dramatization", oracle.DRAMA)
def dramatization(spark, d):
    return stats.dramatisation(stats.smoothed(_means(spark, d), share=10)).withColumn("score", rounded(F.col("score")))


@register("selfsim_hist", oracle.SELFSIM_HIST)
def selfsim_hist(spark, d):
    return stats.value_histogram(stats.self_similarity(day_frames(spark, d)), rounded(F.col("dist")), 128)


def _cells(spark, d):
    return day_frames(spark, d).select("track_id", "frame_no", F.posexplode("bands").alias("band", "value"))


@register("norm_row", oracle.norm("track_id, frame_no"))
def norm_row(spark, d):
    return stats.min_max_scaled(_cells(spark, d), ["track_id", "frame_no"]).select("track_id", "frame_no", "band", rounded(F.col("scaled")).alias("scaled"))


@register("norm_col", oracle.norm("track_id, band"))
def norm_col(spark, d):
    return stats.min_max_scaled(_cells(spark, d), ["track_id", "band"]).select("track_id", "frame_no", "band", rounded(F.col("scaled")).alias("scaled"))


@register("norm_all", oracle.NORM_ALL)
def norm_all(spark, d):
    return stats.globally_scaled(_cells(spark, d)).select("track_id", "frame_no", "band", rounded(F.col("scaled")).alias("scaled"))


@register("raster", oracle.RASTER)
def raster(spark, d):
    r, g, b = arrays.rgb_bytes(stats.clamped(F.col("value")))
    return _cells(spark, d).select("track_id", "frame_no", "band", r.alias("r"), g.alias("g"), b.alias("b"))


@register("matrix_print", oracle.MATRIX_PRINT)
def matrix_print(spark, d):
    return pairs.printed_triangle(tracks(spark, d))


@register("stats_report", oracle.STATS_REPORT)
def stats_report(spark, d):
    return stats.stats_report(stats.band_stats(day_frames(spark, d)))


# Signals


@register("tempo_spectrum", oracle.tempo(False))
def tempo_spectrum(spark, d):
    out = signal.tempo_spectrum(signal.series_of(day_frames(spark, d)), 600.0)
    return out.select("track_id", "f", rounded(F.col("bpm")).alias("bpm"), rounded(F.col("power"), 5).alias("power"))


@register("tempo_compat", oracle.tempo(True))
def tempo_compat(spark, d):
    out = signal.tempo_spectrum(signal.series_of(day_frames(spark, d)), 600.0, compat=True)
    return out.select("track_id", "f", rounded(F.col("bpm")).alias("bpm"), rounded(F.col("power"), 5).alias("power"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("track_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@register("harmonic_product", oracle.HARMONIC)
def harmonic_product(spark, d):
    products = _vectors(spark, d).select("track_id", signal.harmonic_product(F.transform("v", F.abs)).alias("p"))
    return products.select("track_id", F.posexplode("p").alias("bin", "product")).withColumn("product", rounded(F.col("product")))


@register("note_activation", oracle.NOTES)
def note_activation(spark, d):
    products = _vectors(spark, d).select("track_id", signal.harmonic_product(F.transform("v", F.abs), 1).alias("p"))
    return signal.notes(products.select("track_id", signal.binarised(F.col("p")).alias("b")), "b", 64, 128, 8000)


@register("dwt_forward", oracle.DWT)
def dwt_forward(spark, d):
    return _vectors(spark, d).select("track_id", F.posexplode(signal.level(F.col("v"))).alias("k", "x")).withColumn("x", rounded(F.col("x")))


@register("dwt_inverse", oracle.DWT_INVERSE)
def dwt_inverse(spark, d):
    return _vectors(spark, d).select("track_id", F.posexplode(signal.inverse_level(F.col("v"))).alias("k", "x")).withColumn("x", rounded(F.col("x")))


@register("dwt_full", oracle.dwt_full(64))
def dwt_full(spark, d):
    return signal.wavelet(_vectors(spark, d), "v").select("track_id", F.posexplode("v").alias("k", "x")).withColumn("x", rounded(F.col("x"), 5))


@register("dwt_round_trip", oracle.DWT_ROUND_TRIP)
def dwt_round_trip(spark, d):
    back = signal.wavelet(signal.wavelet(_vectors(spark, d), "v"), "v", inverse=True)
    return back.select("track_id", F.posexplode("v").alias("k", "x")).withColumn("x", rounded(F.col("x"), 5))


@register("gabor_cwt", oracle.GABOR)
def gabor_cwt(spark, d):
    return signal.gabor(frames.positions(samples(spark, d)), 400, 16).withColumn("power", rounded(F.col("power"), 4))


@register("spectrum_text", oracle.SPECTRUM_TEXT)
def spectrum_text(spark, d):
    return signal.spectrum_text(day_frames(spark, d))


@register("trajectory", oracle.TRAJECTORY)
def trajectory(spark, d):
    out = signal.trajectory(day_frames(spark, d, LOUD).select("track_id", "frame_no", F.slice("bands", 1, 3).alias("bands")))
    return out.select("track_id", "frame_no", *(rounded(F.col(c)).alias(c) for c in "xyz"))


# Files


@register("ingest_wav", oracle.INGEST)
def ingest_wav(spark, d):
    """Audio files in the shared folder to a track table at production settings, and that table read back."""
    folder = files.shared_folder(spark, "ingest")

    def new_tracks(audio):  # contents are not joined with anything, so no file is shuffled
        return features.tracks_of(files.contents(spark, audio).where(files.has_extension(F.col("path"), ["wav"])))

    new = standins.by_lots(spark, d, folder, new_tracks)
    tables.write_tracks(new.select(files.stem(F.col("fname")).cast("long").alias("track_id"), "length", "frames", "spect_hist"), f"{folder}/db")
    found = tables.read_tracks(spark, f"{folder}/db")
    mass = F.aggregate(F.flatten("spect_hist"), F.lit(0.0), lambda a, x: a + x)
    return found.select("track_id", "length", "frames", F.size("spect_hist").alias("bands"), rounded(mass).alias("mass"))


@register("ingest_stream", oracle.INGEST_STREAM)
def ingest_stream(spark, d):
    """Files that come in three lots into a continuous ingest, which is started anew for each; the histogram cells of the table."""
    folder = files.shared_folder(spark, "follow")
    for share in range(3):
        standins.wave_files(spark, d, f"{folder}/audio/{share}", 1, 8000, share, 3)
        continuous.follow(spark, f"{folder}/audio", f"{folder}/db", SMALL, ["wav"]).awaitTermination()
    cells = continuous.tracks(spark, f"{folder}/db").select(files.stem(F.col("fname")).cast("long").alias("track_id"), "length", "frames", F.posexplode("spect_hist").alias("band", "h"))
    return cells.select("track_id", "length", "frames", "band", F.posexplode("h").alias("bin", "p")).where("p > 0").withColumn("p", rounded(F.col("p")))


def _notes(spark, d, seconds, rate, config):
    folder = files.shared_folder(spark, "notes")

    def notes(audio):
        found = features.note_frames(files.contents(spark, audio), config)
        each = found.select(files.stem(F.col("fname")).cast("long").alias("track_id"), "frame_no", "first_note", F.posexplode("active").alias("k", "on"))
        return each.where("on = 1").select("track_id", "frame_no", (F.col("first_note") + F.col("k")).alias("note"))

    return standins.by_lots(spark, d, folder, notes, seconds, rate)


@register("harmonic_notes", oracle.NOTE_FRAMES)
def harmonic_notes(spark, d):
    """Active notes of each frame of audio files, in small windows."""
    return _notes(spark, d, 1, 8000, EngineConfig(bands=0, window=16, step=8))


@register("harmonic_notes_4096", None)
def harmonic_notes_4096(spark, d):
    """The same at production settings: windows of 4096 at 44.1 kHz, a band for each bin."""
    return _notes(spark, d, 10, 44100, features.HARMONIC)


@register("legacy_round_trip", oracle.LEGACY)
def legacy_round_trip(spark, d):
    """The track table as files of the legacy format, read back."""
    folder = files.shared_folder(spark, "legacy")
    rows = parts(spark, d).drop("exclude").join(tracks(spark, d).drop("exclude"), "track_id")
    files.write_legacy(rows, folder, LEGACY_SHAPE)
    back = files.read_legacy(spark, folder, LEGACY_SHAPE)
    cell = lambda b, k: rounded(F.col("spect_hist")[b][k].cast("double"), 5)
    return back.select("fname", "title", "artist", "album", "track", "length", cell(0, 0).alias("first_cell"), cell(3, 15).alias("last_cell"), "exclude")


@register("track_sink", oracle.LEGACY)
def track_sink(spark, d):
    """The same through the sink that commits whole jobs."""
    datasource.register(spark)
    folder = files.shared_folder(spark, "tracks")
    rows = parts(spark, d).drop("exclude").join(tracks(spark, d).drop("exclude"), "track_id")
    rows.select("fname", "title", "artist", "album", F.col("track").cast("int"), F.col("length").cast("int"), "hist").write.format("bandwright.tracks").options(**datasource.options_of(LEGACY_SHAPE)).mode("overwrite").save(folder)
    back = files.read_legacy(spark, f"{folder}/*.hdb", LEGACY_SHAPE)
    cell = lambda b, k: rounded(F.col("spect_hist")[b][k].cast("double"), 5)
    return back.select("fname", "title", "artist", "album", "track", "length", cell(0, 0).alias("first_cell"), cell(3, 15).alias("last_cell"), "exclude")


@register("audio_source", oracle.AUDIO_SOURCE)
def audio_source(spark, d):
    """Chunks of wave files through the data source."""
    datasource.register(spark)
    folder = files.shared_folder(spark, "audio")

    def chunks(audio):
        found = spark.read.format("bandwright.audio").option("extensions", "wav").load(audio)
        return found.select(files.stem(F.col("path")).cast("long").alias("track_id"), "chunk_no", "frate", F.size("samples").alias("n"), rounded(F.col("samples")[0].cast("double")).alias("first"))

    return standins.by_lots(spark, d, folder, chunks)


for _name, _colored, _inverted in (("raster_gray", False, False), ("raster_color_inverted", True, True)):

    @register(_name, oracle.raster_files(_colored, _inverted))
    def raster_files(spark, d, colored=_colored, inverted=_inverted):
        """Each track's frames as a picture file, read back."""
        datasource.register(spark)
        folder = files.shared_folder(spark, "raster")
        rows = F.transform(F.array_sort(F.collect_list(F.struct("frame_no", "bands"))), lambda x: x["bands"])  # a picture's rows are one file
        images = day_frames(spark, d).groupBy("track_id").agg(rows.alias("rows")).select(F.col("track_id").cast("string").alias("name"), "rows")
        images.write.format("bandwright.raster").options(colored=str(colored).lower(), inverted=str(inverted).lower()).mode("overwrite").save(folder)
        back = files.contents(spark, folder).where(F.col("path").endswith(".ppm" if colored else ".pgm"))
        return back.select(files.stem(F.col("path")).cast("long").alias("track_id"), F.hex("content").alias("content"))


# Clusters


@register("kmeans_seed", oracle.KMEANS_SEED)
def kmeans_seed(spark, d):
    return cluster.spread_seeds(tracks(spark, d), 4).select("cluster_id", "track_id")


@register("kmeans_step", oracle.KMEANS_STEP)
def kmeans_step(spark, d):
    t = tracks(spark, d)
    centres = t.where("track_id < 4").select(F.col("track_id").alias("cluster_id"), "hist")
    new = cluster.centroids(t, cluster.assign(t, centres))
    return new.select("cluster_id", F.posexplode("hist").alias("band", "h")).select("cluster_id", "band", F.posexplode("h").alias("bin", "p")).withColumn("p", rounded(F.col("p")))


@register("kmeans_step_merged", oracle.KMEANS_STEP)
def kmeans_step_merged(spark, d):
    t = tracks(spark, d)
    centres = t.where("track_id < 4").select(F.col("track_id").alias("cluster_id"), "hist")
    new = cluster.merged_centroids(t, cluster.assign(t, centres))
    return new.select("cluster_id", F.posexplode("hist").alias("band", "h")).select("cluster_id", "band", F.posexplode("h").alias("bin", "p")).withColumn("p", rounded(F.col("p")))


@register("merged_moments", oracle.MERGED_MOMENTS)
def merged_moments(spark, d):
    rows = table(spark, d, "lineitem")
    found = aggregates.merged(rows, F.col("l_linenumber"), F.array("l_quantity", "l_extendedprice"), aggregates.Moments())
    names = ("mean_quantity", "mean_price", "var_quantity", "var_price")
    cells = (F.round(F.col("result")[i + 1], 2 if i == 3 else 4).alias(n) for i, n in enumerate(names))
    return found.select(F.col("key").alias("line"), F.col("result")[0].cast("long").alias("n"), *cells)


@register("kmeans_full", None)
def kmeans_full(spark, d):
    return cluster.kmeans(tracks(spark, d), 4)[0]


@register("kmeans_rounds", oracle.kmeans_rounds(3))
def kmeans_rounds(spark, d):
    return cluster.kmeans(tracks(spark, d), 4, rounds=3)[0]


# Radio and streams


def _feedback(spark, d):
    kind = F.create_map(*(F.lit(x) for x in ("click", "click", "view", "play", "purchase", "like", "error", "dislike", "signup", "next")))[F.col("event_type")]
    return table(spark, d, "events").select(F.col("user_id").alias("session"), "ts", "event_id", kind.alias("kind"), F.floor(F.col("value")).cast("long").alias("track_id"))


@register("radio_next", oracle.RADIO_NEXT)
def radio_next(spark, d):
    session = radio.Session(likes=[3, 5], recents=[8], excluded=[3, 5, 8])
    return radio.next_track(tracks(spark, d), parts(spark, d), session, 8).withColumn("distance", rounded(F.col("distance")))


@register("radio_retry", oracle.RADIO_RETRY)
def radio_retry(spark, d):
    before = radio.retry([3, 5, 8])
    return radio.next_track(tracks(spark, d), parts(spark, d), radio.Session(excluded=[3, 5, 8]), before).withColumn("distance", rounded(F.col("distance")))


@register("radio_recent", oracle.RADIO_RECENT)
def radio_recent(spark, d):
    return radio.last_pushed(_feedback(spark, d), "next").select("session", F.array_join(F.transform("tracks", lambda x: x.cast("string")), ",").alias("tracks"))


@register("radio_state", oracle.RADIO_STATE)
def radio_state(spark, d):
    return radio_stream.sessions(_feedback(spark, d)).select("session", "event_id", F.concat_ws(",", F.transform("likes", lambda x: x.cast("string"))).alias("likes"), F.concat_ws(",", F.transform("recents", lambda x: x.cast("string"))).alias("recents"), "n_excluded")


@register("radio_loop", oracle.RADIO_LOOP)
def radio_loop(spark, d):
    """Every session's advances, each giving a track."""
    advance = F.col("kind") == "next"
    events = _feedback(spark, d).withColumns({"track_id": F.when(~advance, F.col("track_id")), "kind": F.when(advance, F.lit("advance")).otherwise(F.col("kind"))})
    return radio.listened(events, tracks(spark, d), parts(spark, d)).withColumn("distance", rounded(F.col("distance")))


@register("play_history", oracle.HISTORY)
def play_history(spark, d):
    plays = _feedback(spark, d).where(F.col("kind").isin("play", "click", "next"))
    seq = F.row_number().over(W.partitionBy("session").orderBy("ts", "event_id"))
    return plays.select("session", seq.alias("seq"), "track_id")


def _stream(spark, d):
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")


@register("stream_framing", oracle.STREAM_FRAMING)
def stream_framing(spark, d):
    import uuid

    rows = _stream(spark, d).select(F.col("user_id").alias("track_id"), "ts", "event_id", "value")
    return framing.drained(framing.hop_frames(rows, SMALL.window, SMALL.step), f"framing-{uuid.uuid4().hex}").withColumn("total", rounded(F.col("total")))


@register("stream_window", oracle.STREAM_WINDOW)
def stream_window(spark, d):
    import uuid

    windows = framing.drained(framing.hop_windows(_stream(spark, d), "2 days", "1 day"), f"windows-{uuid.uuid4().hex}", "complete")
    return windows.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "kind", "n", rounded(F.col("total"), 4).alias("total"))


@register("stream_window_closed", oracle.STREAM_WINDOW_CLOSED)
def stream_window_closed(spark, d):
    """Each window once, when the watermark has passed its end; the state of closed windows goes."""
    import uuid

    windows = framing.drained(framing.hop_windows(_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "2 days", "1 day", late="1 day"), f"closed-{uuid.uuid4().hex}")
    return windows.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "kind", "n", rounded(F.col("total"), 4).alias("total"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}
