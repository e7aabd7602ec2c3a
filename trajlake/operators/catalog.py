"""Catalogue, ledger and file reconciliation."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed
from .blocks import deal

# Acquisition kinds, image extensions, folders that hold images or videos, texture extensions.
KINDS = ("file", "file_images_embedded", "tar_stream", "range_member", "range_package")
IMAGE_EXT = (".mp4", ".avi", ".mkv", ".webm", ".mov", ".m4v", ".png", ".jpg", ".jpeg", ".bmp", ".gif", ".tif", ".tiff",
             ".exr", ".webp", ".heic")
IMAGE_DIRS = ("videos", "images")
TEXTURE_EXT = (".png", ".jpg", ".jpeg", ".bmp", ".tga", ".tif", ".tiff", ".exr", ".webp", ".ktx", ".ktx2", ".dds")
IMAGE_NAME = r"(?i)image|img|rgb|video|depth|camera|pixels"


def _ends(path: Column, extensions: Sequence[str]) -> Column:
    return path.rlike(r"(?i)(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")


def _under(path: Column, folders: Sequence[str]) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike("(^|/)(" + "|".join(folders) + ")/")


def is_image_name(path: Column) -> Column:
    """A path below an image or video folder, or with such an extension."""
    return _under(path, IMAGE_DIRS) | _ends(path, IMAGE_EXT)


def is_texture(content: Column, path: Column) -> Column:
    """A still image catalogued as an asset; videos never qualify."""
    return F.coalesce(content == "assets", F.lit(False)) & _ends(path, TEXTURE_EXT) & ~_under(path, ("videos",))


def refusal(kind: Column, content: Column, path: Column, strip: bool) -> Column:
    """Why an entry must not be fetched; null when it may."""
    embedded = F.lit(not strip) & (kind == "file_images_embedded")
    image = kind.isin("file", "range_member", "file_images_embedded") & is_image_name(path) & ~is_texture(content, path)
    return F.when(embedded, "embeds images").when(image, "image or video file")


def image_dataset(name: Column, dtype: Column, ndim: Column) -> Column:
    """Whether an array dataset looks like images: by name, or an unsigned byte array of three or more axes."""
    return name.rlike(IMAGE_NAME) | ((dtype == "uint8") & (ndim >= 3))


def demo_pattern(name: Column) -> Column:
    """A dataset name with every ``demo_<n>`` part masked."""
    return F.array_join(F.transform(F.split(name, "/"), lambda p: F.when(p.rlike("^demo_[0-9]+$"), "*").otherwise(p)), "/")


def transfer_bytes() -> Column:
    size, stored = F.coalesce("size", F.lit(0)), F.col("stored_size")
    return (F.when(F.col("kind") == "range_member", F.coalesce(F.nullif(stored, F.lit(0)), size) + 512)
            .when(F.col("kind") == "range_package", stored).otherwise(size))


def scratch_bytes() -> Column:
    size = F.coalesce("size", F.lit(0))
    return (F.when(F.col("kind") == "range_package", F.coalesce(F.nullif("inflated_size", F.lit(0)), 4 * F.col("stored_size")))
            .when(F.col("kind") == "file_images_embedded", 2 * size).otherwise(size))


def entries(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Catalogue entries of table rows and the fields their group shares: a row's own value wins; the url comes from
    the row, its archive, or the group's base; faults are listed instead of raised."""
    g = groups.select("group", *[F.col(c).alias(f"g_{c}") for c in groups.columns if c != "group"])
    out = rows.join(g, "group", "left")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"g_{c}"))
    path = F.coalesce("path", F.concat("g_path_prefix", "src"))
    archive_url = F.coalesce("g_archive_url", F.when(F.col("archive_sha256").isNotNull(), F.concat("g_url_base", "archive")))
    url = F.coalesce("url", F.when(F.col("archive").isNotNull(), archive_url), F.concat("g_url_base", "src"))
    kind = F.coalesce("kind", "g_kind", F.lit("file"))
    fault = (F.when(F.col("archive").isNotNull() & archive_url.isNull(), "unknown archive").when(url.isNull(), "no url")
             .when(~kind.isin(*KINDS), "unknown kind"))
    return out.select(F.concat_ws("/", pick("family"), path).alias("id"), pick("family").alias("family"), path.alias("path"), url.alias("url"),
                      kind.alias("kind"), pick("license").alias("license"), F.coalesce("usable", "g_usable", F.lit(True)).alias("usable"), fault.alias("fault"))


def select_entries(catalog: DataFrame, patterns: DataFrame, families: Sequence[str] = (), match: str | None = None) -> DataFrame:
    """Chosen entries in first-seen order: exact ids and prefixes (usable only) by pattern position, then families.

    A prefix joins on the path prefix of its own depth. Exact ids meet their entries in the last aggregation, which goes to as
    many tasks as entries and patterns ask for: no list of ids is joined, broadcast or held by one task."""
    parts = F.split("id", "/")
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    folders = patterns.where(F.col("pattern").endswith("/")).groupBy("pattern").agg(F.min("position").alias("position"))
    late = F.when(F.col("usable") & F.col("family").isin(*families) & (F.col("id").contains(match) if match else F.lit(True)), F.lit(1 << 40))
    # compressed files make the prefixes look small enough to broadcast; the table is built of the folders, prefixes stream by
    below = catalog.where(F.col("usable") & (F.size(parts) > 1)).select("id", prefixes.alias("pattern")).join(folders.hint("shuffle_hash"), "pattern")

    def rows(source: DataFrame, entry: bool, hit: Column, position: Column) -> DataFrame:
        return source.select("id", F.lit(entry).alias("__entry"), hit.alias("__hit"), position.cast("long").alias("position"))

    named = patterns.where("pattern IS NOT NULL").withColumn("id", F.col("pattern"))
    every = (rows(catalog, True, late.isNotNull(), late).unionByName(rows(named, False, F.lit(True), F.col("position")))
             .unionByName(rows(below, True, F.lit(True), F.col("position"))))
    found = deal(every, ["id"], catalog.count() + patterns.count()).groupBy("id").agg(
        F.bool_or("__entry").alias("__entry"), F.bool_or("__hit").alias("__hit"), F.min("position").alias("position"))
    return found.where("__entry AND __hit").select("id", "position")


def missing_patterns(catalog: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns that select nothing."""
    hit = select_matches(catalog, patterns)
    return patterns.join(hit, "pattern", "left_anti")


def select_matches(catalog: DataFrame, patterns: DataFrame) -> DataFrame:
    parts = F.split("id", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    keys = F.when(F.col("usable"), F.concat(prefixes, F.array("id"))).otherwise(F.array("id"))
    return catalog.select(F.explode(keys).alias("pattern")).join(patterns, "pattern", "left_semi").distinct()


def verify(ledger: DataFrame, files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Problems of ledger records: file missing, digest changed, ledger and catalogue disagree (first rule wins)."""
    f = files.select(F.col("path").alias("local_path"), F.col("sha256").alias("have"), F.lit(True).alias("exists"))
    c = catalog.select("id", F.col("sha256").alias("pinned"))
    # compressed files look small enough to broadcast, their digests and paths are not: neither side goes through the driver
    out = ledger.join(f.hint("merge"), "local_path", "left").join(c.hint("merge"), "id", "left")
    problem = (F.when(F.col("exists").isNull(), "missing").when(F.col("have") != F.col("sha256_verified"), "sha256 mismatch")
               .when(F.col("pinned") != F.col("sha256_verified"), "ledger differs from catalog"))
    return out.select("id", problem.alias("problem")).where(F.col("problem").isNotNull())


def not_fetched(catalog: DataFrame, ledger: DataFrame, members: DataFrame) -> DataFrame:
    """Usable entries without a ledger record, unless they are packages whose members are all recorded."""
    wanted = catalog.where("usable").join(ledger.select("id"), "id", "left_anti")
    have = ledger.select(F.col("id").alias("member_id"), F.lit(True).alias("__have")).distinct()
    whole = members.join(have, "member_id", "left").groupBy("id").agg(F.bool_and(F.coalesce("__have", F.lit(False))).alias("__all"))
    packages = F.coalesce((F.col("kind") == "range_package") & F.col("__all"), F.lit(False))
    return wanted.join(whole, "id", "left").where(~packages).select("id")


def identify(files: DataFrame, catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    """Catalogue entry of every file: by its content, else by its place when the ledger recorded the same content there."""
    pinned = catalog.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.min("id").alias("by_content"))
    out = files.join(pinned.hint("merge"), "sha256", "left")
    led = ledger.select(F.col("local_path").alias("path"), F.col("sha256_verified").alias("__led"))
    out = out.join(led.hint("merge"), "path", "left").withColumn("__place", F.regexp_replace("path", "^raw/", ""))
    cat = catalog.select(F.col("id").alias("__place"), F.col("sha256").alias("__pin"), F.lit(True).alias("__known"))
    out = out.join(cat.hint("merge"), "__place", "left")
    agreed = F.col("__known") & (F.col("__led") == F.col("sha256")) & (F.col("__pin").isNull() | (F.col("__pin") == F.col("sha256")))
    entry = F.coalesce("by_content", F.when(agreed, F.col("__place")))
    return out.select("path", entry.alias("entry"), F.when(F.col("by_content").isNotNull(), "content").when(agreed, "place").alias("how"))


def merge_roots(roots: Sequence[DataFrame], key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """No-overwrite merge: one row per key where the roots agree, and the conflicting keys."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r.select(key, digest) for r in roots])
    g = every.groupBy(key).agg(F.min(digest).alias("__lo"), F.max(digest).alias("__hi"), F.count(F.lit(1)).alias("copies"))
    same = F.col("__lo").eqNullSafe(F.col("__hi"))
    return g.where(same).select(key, F.col("__lo").alias(digest), "copies"), g.where(~same).select(key, "copies")


def passed_checks(**pairs: tuple[Column, Column]) -> Column:
    """Names of the digests that are pinned, present and equal."""
    return F.array_compact(F.array(*[F.when(pin == got, F.lit(name)) for name, (pin, got) in pairs.items()]))


def normalize_path(path: Column, data_root: str) -> Column:
    """A listed path relative to the data root; null for an absolute path elsewhere."""
    p = F.regexp_replace(F.trim(path), r"^\./", "")
    inside = F.trim(path).startswith(data_root + "/")
    return (F.when(inside, F.substring(F.trim(path), len(data_root) + 2, 1 << 30)).when(p.startswith("raw/") | p.startswith("derived/"), p)
            .when(p.startswith("/"), F.lit(None)).otherwise(F.concat(F.lit("raw/"), p)))


def parse_listing(lines: DataFrame, data_root: str) -> DataFrame:
    """``<size> <path>`` or ``<path>`` lines (column ``value``, position ``line``): size per path, the last line wins."""
    text = F.trim("value")
    sized = F.regexp_extract(text, r"^(\d+) +(.+)$", 1)
    path = F.when(sized != "", F.regexp_extract(text, r"^(\d+) +(.+)$", 2)).otherwise(text)
    rows = lines.where(text != "").select("line", F.when(sized != "", sized.cast("long")).otherwise(F.lit(0)).alias("size"),
                                          path.alias("listed"), normalize_path(path, data_root).alias("path"))
    return rows.groupBy("path").agg(F.max_by("size", "line").alias("size"), F.count(F.lit(1)).alias("lines"))


def listing_line(family: str | None = None) -> list[Column]:
    """The columns of a catalogue listing: id, size in MB, kind, content, licence, flag."""
    size = F.when(F.col("size").isNull(), "?").otherwise(F.concat(fixed(F.col("size") / 1e6, 1), F.lit(" MB")))
    flag = F.when(F.col("usable"), F.lit(None).cast("string")).otherwise("unusable")
    return [F.concat_ws("\t", "id", size, "kind", F.coalesce("content", F.lit("")), "license", flag).alias("line")]


def running_jobs(events: DataFrame) -> DataFrame:
    """Jobs whose latest event is a launch (finished and requeued ones are not running)."""
    last = events.groupBy("id").agg(F.max_by("event", "t").alias("event"), F.max("t").alias("t"))
    return last.where(F.col("event") == "launched").select("id", "t")




def package_of(files: DataFrame, packages: DataFrame, members: DataFrame) -> DataFrame:
    """Package of every file: the one that lists its digest, else the one of its folder (the first id in both cases).

    ``packages``: id, folder; ``members``: id, sha256; ``files``: path, sha256."""
    by_digest = members.groupBy("sha256").agg(F.min("id").alias("__digest"))
    by_folder = packages.groupBy("folder").agg(F.min("id").alias("__folder"))
    out = files.withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).join(by_digest, "sha256", "left").join(by_folder, "folder", "left")
    return out.select("path", F.coalesce("__digest", "__folder").alias("package"))


def export_status(episodes: DataFrame, assets: DataFrame) -> DataFrame:
    """Whether an episode's scene can be exported: physics recorded, source known, every asset found in the scene itself.

    ``episodes``: uid, has_physics, source; ``assets``: uid, found."""
    inside = assets.groupBy("uid").agg(F.bool_and(F.col("found").startswith("assets:")).alias("__inside"))
    status = (F.when(~F.col("has_physics"), "no_physics").when(F.col("source").isNull(), "no_source")
              .when(~F.coalesce("__inside", F.lit(True)), "unresolved_assets").otherwise("candidate"))
    return episodes.join(inside, "uid", "left").select("uid", status.alias("status"))
