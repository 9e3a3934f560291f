"""Domain frames built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.sources.tables import table

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-12-01 00:00:00"
PLACES = ["Race track", "Portrait studio", "Mountain park", "City street", "Beach", "Warehouse"]
MAKERS = ["canon", "sony", "nikon", "film"]


class Lake:
    """The domain frames of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def users(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_mktsegment") != "BUILDING", F.lower("c_mktsegment")).alias("plan"),
            F.concat(
                F.when(F.col("c_custkey") % 7 == 0, F.lit("no mail")).otherwise(
                    F.concat(F.lit("User"), (F.col("c_custkey") % 1000).cast("string"))
                ),
                F.lit("@example.org"),
            ).alias("email"),
            (F.col("c_acctbal") > 0).alias("is_active"),
        )

    def organizations(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("org_id"),
            F.col("n_name").alias("org_name"),
            F.lower("n_name").alias("slug"),
        )

    def memberships(self) -> DataFrame:
        """Each user belongs to two organizations with one role."""
        c = self.raw("customer")
        digit = F.col("c_custkey") % 10
        role = F.when(digit == 0, "admin").when(digit <= 6, "member").otherwise("viewer")
        orgs = F.array(F.col("c_nationkey"), (F.col("c_nationkey") + 1) % 25)
        return c.select(
            F.col("c_custkey").alias("user_id"), F.explode(orgs).alias("org_id"), role.alias("role")
        )

    def projects(self) -> DataFrame:
        """Projects without their organization (no join)."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("project_id"),
            F.concat(
                F.lit("Shoot "),
                F.lower(F.substr(F.col("o_orderpriority"), F.lit(3))),
                F.lit(" "),
                F.col("o_orderkey").cast("string"),
            ).alias("name"),
            F.col("o_custkey").alias("user_id"),
            F.when(F.col("o_orderstatus") == "O", "active")
            .when(F.col("o_orderstatus") == "F", "archived")
            .otherwise("draft")
            .alias("status"),
            F.col("o_orderdate").alias("updated_at"),
            (F.col("o_totalprice") / F.lit(100000)).cast("long").alias("stored_count"),
            (F.col("o_orderkey") % 2500).alias("default_preset_id"),
            (F.col("o_custkey") % 100).alias("camera_id"),
            (F.col("o_orderkey") * 10 + 1).alias("cover_slot"),
        )

    def tenant_projects(self) -> DataFrame:
        """Projects with the organization of their owner."""
        owner = self.raw("customer").select(
            F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("org_id")
        )
        return self.projects().join(owner, "user_id")

    def photos(self) -> DataFrame:
        """Photos without title and tags (no join)."""
        return self.raw("lineitem").select(*self._photo_columns())

    def shots(self) -> DataFrame:
        """Photos with the camera settings that ``exif`` has, from one scan."""
        return self.raw("lineitem").select(*self._photo_columns(), *self._exif_columns())

    def _photo_columns(self) -> list[Column]:
        return [
            self._photo_id().alias("photo_id"),
            F.col("l_orderkey").alias("project_id"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("slot"),
            F.col("l_suppkey").alias("camera_id"),
            F.col("l_partkey").alias("preset_id"),
            self._photo_status().alias("status"),
            F.col("l_shipdate").alias("created_at"),
            F.col("l_shipdate").alias("updated_at"),
            (F.col("l_discount") * F.lit(10.0)).alias("upload_progress"),
            self._upload_status().alias("upload_status"),
            F.concat(
                F.lit("DSC_"),
                F.format_string(
                    "%04d", F.col("l_linenumber").cast("long") * 100 + F.col("l_quantity").cast("long")
                ),
            ).alias("original"),
            F.slice(
                F.array(F.lit("16x9"), F.lit("1x1"), F.lit("9x16")),
                F.lit(1),
                F.col("l_linenumber") % 3 + 1,
            ).alias("export_formats"),
        ]

    def tagged_photos(self) -> DataFrame:
        """Photos with title, description and tags of the part they show."""
        labels = self.raw("part").select(
            F.col("p_partkey").alias("preset_id"),
            F.col("p_name").alias("title"),
            F.col("p_brand").alias("description"),
            self._tags().alias("tags"),
        )
        return self.photos().join(labels, "preset_id")

    def search_assets(self) -> DataFrame:
        """Photos with every field the search looks at."""
        looks = self.raw("part").select(
            F.col("p_partkey").alias("preset_id"),
            F.col("p_name").alias("title"),
            self._tags().alias("tags"),
            F.when(F.col("p_size") % 4 != 3, F.col("p_brand")).alias("preset_name"),
        )
        return (
            self.photos()
            .withColumns(
                {
                    "camera": F.when(
                        F.col("camera_id") % 5 != 4, _pick(MAKERS, F.col("camera_id") % 4)
                    ),
                    "location": F.when(
                        F.col("camera_id") % 7 != 6, _pick(PLACES, F.col("camera_id") % 6)
                    ),
                }
            )
            .join(looks, "preset_id")
        )

    def exif(self) -> DataFrame:
        """Camera settings per photo."""
        ids = [self._photo_id().alias("photo_id"), F.col("l_orderkey").alias("project_id"), F.col("l_partkey").alias("preset_id")]
        return self.raw("lineitem").select(*ids, *self._exif_columns())

    @staticmethod
    def _exif_columns() -> list[Column]:
        return [
            (F.lit(100) + F.col("l_quantity") * 100).cast("int").alias("iso"),
            (F.col("l_partkey") % 24).cast("int").alias("hour"),
            _pick(PLACES, F.col("l_suppkey") % 6).alias("location"),
            _pick(MAKERS, F.col("l_suppkey") % 4).alias("camera"),
            F.when(
                F.col("l_suppkey") % 10 != 9,
                F.lit(1.4).cast("double") + F.lit(0.7).cast("double") * F.col("l_linenumber"),
            ).alias("aperture"),
            (F.lit(1.0).cast("double") / (F.lit(20.0) * F.col("l_quantity"))).alias("shutter"),
            (F.col("l_extendedprice") / 20).cast("int").alias("long_edge"),
            (F.col("l_quantity") * 2).alias("exposure_quality"),
        ]

    def presets(self) -> DataFrame:
        """Presets; some carry a style name or text that rules look for. No preset serves the rules
        'Track Day' and 'Sunset Glow', so photos matching those fall through."""
        styles = ["Night Shooter", "Portrait Pro", "Landscape Master", "urban edge", "Vintage FILM"]
        style = F.col("p_size") % 10
        return self.raw("part").select(
            F.col("p_partkey").alias("preset_id"),
            F.concat_ws(
                " ", F.col("p_name"), F.when(style < 5, _pick(styles, style))
            ).alias("name"),
            F.concat_ws(
                " ",
                F.col("p_brand"),
                F.when(style == 5, F.lit("monochrome with rich blacks")),
            ).alias("description"),
            F.col("p_type").alias("category"),
            (F.col("p_partkey") % 1500).alias("owner_id"),
            (F.col("p_size") % 2 == 0).alias("is_public"),
            (F.col("p_size") % 3 == 0).alias("shared"),
        )

    def cameras(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("camera_id"),
            F.col("s_suppkey").alias("owner_id"),
            F.col("s_name").alias("camera_name"),
        )

    def events(self) -> DataFrame:
        return self.raw("events").select(
            "event_id",
            "ts",
            "user_id",
            "event_type",
            "value",
            "props",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    def health(self) -> DataFrame:
        """Health checks: errors are failures."""
        return self.events().select(
            "event_id",
            F.col("ts").alias("check_time"),
            F.col("event_type").alias("check_type"),
            F.when(F.col("event_type") == "error", "fail").otherwise("success").alias("status"),
            F.col("props").alias("details"),
            F.col("value").cast("int").alias("response_time_ms"),
        )

    def queue(self) -> DataFrame:
        """Upload queue states per item (one item per user), with progress in percent."""
        state = (
            F.when(F.col("event_type") == "signup", "pending")
            .when(F.col("event_type").isin("view", "click"), "syncing")
            .when(F.col("event_type") == "purchase", "completed")
            .otherwise("failed")
        )
        return self.events().select(
            "event_id",
            "ts",
            F.col("user_id").alias("item_id"),
            state.alias("status"),
            F.col("k").cast("double").alias("progress"),
        )

    def audit(self) -> DataFrame:
        """Key and certificate operations, one key per user; a renewal may have failed."""
        e = self.events()
        op = (
            F.when(F.col("event_type") == "signup", "STORE")
            .when(F.col("event_type") == "view", "RETRIEVE")
            .when(F.col("event_type") == "purchase", "ROTATE")
            .when(F.col("event_type") == "click", "DELETE")
            .otherwise("FAIL")
        )
        return e.select(
            "event_id",
            "ts",
            op.alias("op"),
            F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("key"),
            F.concat(F.lit("user"), (F.col("k") % 10).cast("string")).alias("user"),
            F.when(F.col("k") % 4 != 0, F.concat(F.lit("host"), (F.col("k") % 3).cast("string"))).alias(
                "client"
            ),
            (F.col("k") >= 20).alias("succeeded"),
        )

    def captions(self) -> DataFrame:
        return self.raw("documents").select(
            "doc_id",
            F.get(F.split("text", "\n"), F.lit(0)).alias("title"),
            F.col("text").alias("description"),
            "lang",
            "source",
        )

    def edits(self) -> DataFrame:
        """Edit history; each step carries two adjustments, one of which may be missing."""
        return self.raw("conversations").select(
            F.col("conv_id").alias("item_id"),
            F.col("turn"),
            F.col("role").alias("action"),
            F.create_map(
                F.lit("exposure"),
                (F.length("text") % 21).cast("double"),
                F.lit("contrast"),
                F.when(F.col("turn") % 3 != 1, (F.length("text") % 7).cast("double")),
            ).alias("adjustments"),
        )

    @staticmethod
    def _photo_id() -> Column:
        """The columns that together identify a photo, as one text."""
        return F.concat_ws(
            "-",
            F.col("l_orderkey").cast("string"),
            F.col("l_linenumber").cast("string"),
            F.col("l_partkey").cast("string"),
            F.col("l_suppkey").cast("string"),
            F.col("l_shipdate").cast("date").cast("string"),
        )

    @staticmethod
    def _photo_status() -> Column:
        return (
            F.when(F.col("l_returnflag") == "A", "published")
            .when(F.col("l_returnflag") == "R", "exported")
            .when(F.col("l_linestatus") == "F", "processed")
            .otherwise("raw")
        )

    @staticmethod
    def _upload_status() -> Column:
        states = ["queued", "uploading", "paused", "error", "synced"]
        n = F.col("l_linenumber") % 6
        return F.when(n < 5, _pick(states, n))

    @staticmethod
    def _tags() -> Column:
        return F.array_append(F.split("p_name", " "), F.lower("p_type"))


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))
