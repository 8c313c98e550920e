"""Camera-observation views derived from the supplied tables.

The supplied tables hold no camera data, so each view computes it from their columns with plain
formulas; ``oracle_views`` states the same formulas in SQL. Row counts follow the tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hallwatch.functions.vectors import unit

BASE_MS = 1_704_067_200_000  # 2024-01-01 00:00:00 UTC
FRAME_W, FRAME_H = 1280, 720
NOW = dt.datetime(2024, 2, 10)                    # for the event log
TRACK_NOW = dt.datetime(2024, 1, 2, 2, 46, 40)    # for stored tracks: base + 24 h + 10,000 s

# Fixed values of the test scene.
EXCLUSION = (0.5, 0.0, 0.75, 0.6)
ZONES = {
    "A": [[0.0, 0.2], [0.4, 0.2], [0.4, 1.0], [0.0, 1.0]],
    "B": [[0.7, 0.3], [1.0, 0.3], [1.0, 1.0], [0.7, 1.0]],
    "C": [[0.2, 0.1], [0.8, 0.5], [0.2, 1.0]],
}


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---- dimensions -------------------------------------------------------------------------

    def cameras(self) -> DataFrame:
        """Four cameras, each with the same exclusion rectangle."""
        area = F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), EXCLUSION)])
        return self.spark.range(4).select(camera(F.col("id")).alias("camera_id"), F.array(area).alias("exclusion_zones"))

    def zones(self) -> DataFrame:
        entries = F.array(*[
            F.struct(F.lit(i).alias("zone_ord"), F.lit(n).alias("name"),
                     F.array(*[F.array(*map(F.lit, v)) for v in points]).alias("polygon"))
            for i, (n, points) in enumerate(ZONES.items())])
        return (self.spark.range(4).select(camera(F.col("id")).alias("camera_id"), F.explode(entries).alias("z"))
                .select("camera_id", "z.*", F.lit(5.0).alias("max_handover_sec")))

    def edges(self) -> DataFrame:
        """A ring of four cameras: i leaves on the right to i+1, entering on its left; and back."""
        right, left = F.array(*map(F.lit, (0.7, 0.0, 1.0, 1.0))), F.array(*map(F.lit, (0.0, 0.0, 0.3, 1.0)))
        ring = self.spark.range(4).select(
            F.col("id").alias("overlap_ord"), F.array(camera(F.col("id")), camera((F.col("id") + 1) % 4)).alias("cameras"),
            right.alias("cam1_exit_zone"), left.alias("cam2_entry_zone"), (F.col("id") + 2.0).alias("max_handover_sec"))
        from hallwatch.sources.dimensions import edge_dimension
        return edge_dimension(ring)

    def camera_config(self) -> DataFrame:
        """One configured camera per supplier, with none to two exclusion rectangles."""
        k = F.col("s_suppkey")
        area = F.struct((k % 5 / 10.0).alias("x1"), F.lit(0.0).alias("y1"), (k % 5 / 10.0 + 0.2).alias("x2"), F.lit(0.5).alias("y2"))
        none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
        areas = F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(area)).otherwise(F.array(area, area))
        return self.table("supplier").select(
            camera(k).alias("camera_id"), F.when(k % 2 == 0, F.col("s_name")).alias("name"),
            F.when(k % 4 != 0, (k % 30).cast("int")).alias("fps"), F.when(k % 6 != 0, areas).alias("exclusion_zones"))

    def zone_config(self) -> DataFrame:
        """One zone per supplier, seen by two neighbouring cameras."""
        k, nation = F.col("s_suppkey"), F.col("s_nationkey")
        polygon = F.array(*[F.array((k % 5 / 10.0) + x, F.lit(y)) for x, y in ((0.0, 0.2), (0.4, 0.2), (0.4, 1.0))])
        value = F.struct(polygon.alias("polygon"))
        return self.table("supplier").select(
            k.cast("int").alias("zone_ord"), F.concat(F.lit("zone_"), k.cast("string")).alias("name"),
            F.when(k % 4 != 0, (k % 9).cast("double")).alias("max_handover_sec"),
            F.create_map(camera(nation), value, camera(nation + 1), value).alias("cameras"))

    def overlap_config(self) -> DataFrame:
        """One camera overlap per supplier."""
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("overlap_ord"), F.array(camera(F.col("s_nationkey")), camera((F.col("s_nationkey") * 7 + 3) % 25)).alias("cameras"),
            F.array(k % 5 / 10.0, F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("cam1_exit_zone"),
            F.array(F.lit(0.0), F.lit(0.0), k % 7 / 10.0, F.lit(1.0)).alias("cam2_entry_zone"),
            F.when(k % 4 != 0, (k % 10).cast("double")).alias("max_handover_sec"))

    # ---- observations -----------------------------------------------------------------------

    def frames(self) -> DataFrame:
        e = F.col("event_id")
        return self.table("events").select(
            camera(e % 4).alias("camera_id"), (F.expr("event_id div 4") + 1).alias("frame_number"), at_ms(e * 200).alias("ts"),
            F.lit(FRAME_W).alias("frame_w"), F.lit(FRAME_H).alias("frame_h"), (F.col("value") / 10000.0).alias("motion_ratio"),
            (F.col("event_type") == "purchase").alias("active"))

    def detections(self) -> DataFrame:
        k, q = F.col("l_orderkey"), F.col("l_quantity")
        x1 = ((F.col("l_partkey") * 37) % 1080).cast("double")
        y1 = ((F.col("l_suppkey") * 53) % 300).cast("double")
        return self.table("lineitem").select(
            camera(k % 4).alias("camera_id"), (F.expr("l_orderkey div 4") + 1).alias("frame_number"), at_ms(k * 200).alias("ts"),
            det_id().alias("det_id"), x1.alias("x1"), y1.alias("y1"), (x1 + 60 + 2 * q).alias("x2"), (y1 + 120 + 6 * q).alias("y2"),
            (F.lit(0.3) + 6 * F.col("l_discount")).alias("confidence"),
            F.when(F.col("l_linenumber") % 7 == 0, 1).otherwise(0).alias("class_id"),
            F.lit(FRAME_W).alias("frame_w"), F.lit(FRAME_H).alias("frame_h"))

    def observations(self) -> DataFrame:
        """Which track is visible in which frame, and whether the frame shows motion."""
        k = F.col("l_orderkey")
        return self.table("lineitem").select(
            camera(k % 4).alias("camera_id"), (F.expr("l_orderkey div 4") + 1).alias("frame_number"), at_ms(k * 200).alias("ts"),
            (F.col("l_suppkey") % 20).alias("track_id"), (F.expr("l_orderkey div 4") % 5 == 0).alias("has_motion")).distinct()

    def faces(self) -> DataFrame:
        """Faces inside person crops (crop = camera, frame, track), with the person box around them."""
        k = F.col("l_orderkey")
        px, py = (F.col("l_partkey") % 900).cast("double"), (F.col("l_suppkey") % 200).cast("double")
        x1 = px + F.col("l_linenumber") * 10
        y1 = py + (F.col("l_partkey") % 240)
        side = 10 + F.col("l_quantity") * 3
        return self.table("lineitem").select(
            camera(k % 4).alias("camera_id"), (F.expr("l_orderkey div 4") + 1).alias("frame_number"), at_ms(k * 200).alias("ts"),
            (F.col("l_suppkey") % 5).alias("track_id"), det_id().alias("face_id"),
            x1.alias("x1"), y1.alias("y1"), (x1 + side).alias("x2"), (y1 + side + F.col("l_linenumber")).alias("y2"),
            (F.lit(0.5) + F.col("l_tax") * 5).alias("confidence"),
            px.alias("person_x1"), py.alias("person_y1"), (px + 150.5).alias("person_x2"), (py + 400.0).alias("person_y2"))

    def crops(self) -> DataFrame:
        k = F.col("l_orderkey")
        return self.table("lineitem").select(
            camera(k % 4).alias("camera_id"), (F.expr("l_orderkey div 4") + 1).alias("frame_number"), at_ms(k * 200).alias("ts"),
            F.col("l_partkey").alias("track_id"), det_id().alias("crop_id"),
            (20 + 3 * F.col("l_quantity")).cast("int").alias("width"), (60 + F.col("l_partkey") % 300).cast("int").alias("height"),
            (F.col("l_suppkey") % 60).cast("double").alias("mean_saturation"), (F.col("l_extendedprice") % 800).alias("laplacian_var"))

    # ---- people and vectors -----------------------------------------------------------------

    def persons(self) -> DataFrame:
        p = self.table("embeddings").select(F.col("label").cast("long").alias("person_id")).distinct()
        return p.select("person_id", F.concat(F.lit("person_"), F.col("person_id").cast("string")).alias("name"),
                        (F.col("person_id") != 9).alias("is_active"))

    def face_embeddings(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("emb_id"), F.col("label").cast("long").alias("person_id"), "embedding")

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "embedding")

    def vector_count(self) -> Column:
        return self.table("embeddings").select(F.count(F.lit(1))).scalar()

    def probes(self) -> DataFrame:
        """Query vectors: near one enrolled vector (even ids) or between three (odd ids)."""
        n = self.vector_count()
        q, v = F.col("query_id"), self.vectors()
        ids = v.select(F.col("vec_id").alias("query_id")).select("query_id", ((q * 7 + 3) % n).alias("second"), ((q * 11 + 5) % n).alias("third"))

        def named(key, column):
            return v.select(F.col("vec_id").alias(key), F.col("embedding").alias(column))

        d = ids.join(named("query_id", "a"), "query_id").join(named("second", "b"), "second").join(named("third", "c"), "third")
        near = F.zip_with("a", "b", lambda x, y: 0.9 * x.cast("double") + 0.43589 * y.cast("double"))
        two = F.zip_with("a", "b", lambda x, y: 0.57 * x.cast("double") + 0.57 * y.cast("double"))
        far = F.zip_with(two, F.col("c"), lambda x, y: x + 0.59 * y.cast("double"))
        return d.select("query_id", F.when(q % 2 == 0, near).otherwise(far).alias("embedding"), (q % 7 == 3).alias("gated"))

    def with_vector(self, rows: DataFrame, number: Column) -> DataFrame:
        n = self.vector_count()
        return rows.withColumn("vec_id", number % n).join(self.vectors(), "vec_id")

    def with_own_vector(self, rows: DataFrame, number: Column) -> DataFrame:
        """As ``with_vector``, but near itself only: the supplied table may hold copies and near copies, so the vector is
        lengthened by the code of its number. Cosines of different numbers stay below 0.54."""
        d = self.with_vector(rows, number)
        signs = [(1 - 2 * (F.bit_count(F.col("vec_id").bitwiseAND(F.lit(mask))) % 2)) / F.lit(48 ** 0.5) for mask in number_code()]
        return d.withColumn("embedding", F.concat(F.transform(unit(F.col("embedding")), lambda x: 0.25 * x), F.array(*signs)))

    # ---- tracks and events ------------------------------------------------------------------

    def spans(self) -> DataFrame:
        """Local tracks from entry to exit."""
        return self.table("orders").select(*_span())

    def seen_spans(self) -> DataFrame:
        """Local tracks with their vector, and whether it is known at the entry and at the exit (as in ``entries`` and
        ``exits``). The columns are computed after the join, so that only the two keys of a row travel to the vectors."""
        d = self.with_vector(self.table("orders").select("o_orderkey", "o_custkey"), F.col("o_custkey"))
        o = F.col("o_orderkey")
        return d.select(*_span(), "embedding", (o % 3 != 0).alias("seen_in"), (o % 4 != 0).alias("seen_out")).drop("vec_number")

    def exits(self, limit: float) -> DataFrame:
        d = self.spans().select(F.col("track_id").alias("exit_id"), "camera_id", "zone", "site_id", F.col("exited_at").alias("exit_ts"),
                                F.lit(limit).alias("limit_sec"), "vec_number")
        has = F.when(F.col("exit_id") % 4 != 0, F.col("embedding"))
        return self.with_vector(d, F.col("vec_number")).withColumn("embedding", has).drop("vec_id", "vec_number")

    def entries(self, limit: float = 0.0) -> DataFrame:
        d = self.spans().select(F.col("track_id").alias("entry_id"), "camera_id", "zone", "site_id", F.col("entered_at").alias("entry_ts"),
                                "quality", "alone", "vec_number")
        has = F.when(F.col("entry_id") % 3 != 0, F.col("embedding"))
        return self.with_vector(d, F.col("vec_number")).withColumn("embedding", has).drop("vec_id", "vec_number")

    def face_checks(self) -> DataFrame:
        e = F.col("event_id")
        return self.table("events").select(
            F.col("user_id").alias("track_id"), e.alias("obs_id"), at_ms(e * 200).alias("ts"), (F.expr("event_id div 4") + 1).alias("frame_number"),
            F.when(F.col("event_type") != "error", F.expr("event_id div 3") % 3).alias("candidate"), (F.col("value") / 600.0).alias("score"))

    def event_log(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), camera(F.col("user_id") % 4).alias("camera_id"), "event_type",
            F.col("user_id").cast("string").alias("track_id"), (F.col("user_id") % 10).alias("person_id"),
            (F.col("value") / 600.0).alias("confidence"), F.col("props").alias("extra_data"))

    def stored_tracks(self) -> DataFrame:
        o, c = F.col("o_orderkey"), F.col("o_custkey")
        status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "lost").otherwise("archived")
        state = F.when(F.col("o_orderstatus") == "O", "tracked").when(F.col("o_orderstatus") == "F", "lost").otherwise("removed")
        return self.table("orders").select(
            F.concat(F.lit("global_"), o.cast("string")).alias("track_id"), F.when(c % 3 != 0, c % 12).alias("person_id"),
            at_ms(o * 2000).alias("first_seen"), at_ms(o * 2000 + (c % 20) * 1000).alias("last_seen"),
            camera(c % 4).alias("last_camera_id"), status.alias("status"), state.alias("state"))

    def walkers(self) -> tuple[DataFrame, DataFrame]:
        """Frames and three straight walkers per camera, with pauses long enough to empty the tracker."""
        f = self.frames().select("camera_id", "frame_number", "ts")
        n, who = F.col("frame_number"), F.col("det_id")
        d = (f.withColumn("det_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
             .filter(((n + who) % 11 != 0) & (F.floor(n / 50) % 5 != 4)))
        x1, y1 = ((131 * who + 7 * n) % 1000).cast("double"), (100 + 40 * who).cast("double")
        d = d.select("camera_id", "frame_number", "ts", "det_id", x1.alias("x1"), y1.alias("y1"), (x1 + 80).alias("x2"), (y1 + 200).alias("y2"),
                     F.when((n + who) % 13 == 0, 0.4).otherwise(0.9).alias("confidence"))
        return f, d


def walker_scene(v: Views) -> dict[str, DataFrame]:
    """Inputs of the whole composition: walkers with crops and faces. Every walker of every stretch between two pauses has
    the vector of one enrolled face, taken from the whole table, so each has a true identity."""
    _, d = v.walkers()
    d = d.withColumn("class_id", F.lit(0))
    stretch, place = F.floor(F.col("frame_number") / 250), F.substring("camera_id", 5, 9).cast("long")
    shown = v.with_vector(d.drop("confidence", "class_id"), stretch * 31 + place * 17 + F.col("det_id") * 7).drop("vec_id")
    crops = shown.select("camera_id", "frame_number", "det_id", "embedding", F.lit(160).alias("width"), F.lit(320).alias("height"),
                         F.lit(60.0).alias("mean_saturation"), F.lit(600.0).alias("laplacian_var"))
    faces = shown.select("camera_id", "frame_number", "det_id", "embedding", F.lit(0).alias("face_id"), F.lit(0.9).alias("confidence"),
                         (F.col("x1") - 5).alias("x1"), F.col("y1"), (F.col("x1") + 80).alias("x2"), (F.col("y1") + 85).alias("y2"))
    return dict(frames=v.frames().drop("active"), detections=d, crops=crops, faces=faces, cameras=v.cameras(), zones=v.zones(),
                persons=v.persons(), embeddings=v.face_embeddings())


def number_code() -> list[int]:
    """Quadratic residue code of length 48: bit k of the word of a number (below 2^24) is the parity of its bits under mask k.
    Any two words differ in 12 bits or more."""
    powers = (0, 1, 2, 3, 5, 6, 7, 9, 10, 12, 13, 14, 18, 19, 23)
    masks = [sum(1 << i for i in range(24) if k - i in powers) for k in range(47)]
    whole = 0
    for mask in masks:
        whole ^= mask
    return [*masks, whole]


def _span() -> list[Column]:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return [o.alias("track_id"), camera(o % 4).alias("camera_id"), F.concat(F.lit("zone_"), (o % 3).cast("string")).alias("zone"),
            F.concat(F.lit("site_"), (o % 5).cast("string")).alias("site_id"),
            at_ms(o * 2000).alias("entered_at"), at_ms(o * 2000 + (c % 20) * 1000).alias("exited_at"),
            (F.lit(0.3) + (o % 8) / 10.0).alias("quality"), (o % 3 != 1).alias("alone"), c.alias("vec_number")]


def camera(number: Column) -> Column:
    return F.concat(F.lit("cam_"), number.cast("string"))


def at_ms(offset: Column) -> Column:
    return F.timestamp_millis(F.lit(BASE_MS) + offset)


def t_ms(ts: str | Column) -> Column:
    """Timestamps leave queries as whole milliseconds."""
    return F.unix_millis(F.col(ts) if isinstance(ts, str) else ts)


def det_id() -> Column:
    """Number of a detection in its frame, packed from the row's own columns."""
    packed = ((F.col("l_partkey") * 100_000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("long")
    return packed.cast("long")
