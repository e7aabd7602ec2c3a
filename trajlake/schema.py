"""Canonical table schemas."""
from __future__ import annotations

from pyspark.sql import types as T

from .functions.pose import POSE7

GEOMETRY = ("struct<kind:string,frame:string,center:array<double>,half_extents:array<double>,radius:double,half_length:double,axis:string,"
            "boxes:array<struct<center:array<double>,half_extents:array<double>>>>")
VERDICT = "struct<passed:boolean,reasons:array<string>>"

EPISODE_INDEX = ("uid string, file string, family string, dataset string, task string, regime string, body_parts array<string>, tier_k_passed boolean, "
                 "tier_p_passed boolean, license string, lineage_seed string, variant_of string, length bigint, duration double")
FRAMES = (f"uid string, row bigint, time double, source_time double, q array<double>, qd array<double>, left_tcp {POSE7}, right_tcp {POSE7}, head {POSE7}, "
          "opening array<double>, grasp_left smallint, grasp_right smallint")
OBJECTS = f"uid string, object string, role string, geometry {GEOMETRY}"
OBJECT_FRAMES = f"uid string, object string, row bigint, pose {POSE7}, valid boolean"
BUILD_RECORDS = (f"family string, dataset string, task string, uid string, status string, excluded string, reason string, K {VERDICT}, P {VERDICT}, "
                 "body_parts array<string>, regime string, file string, scene struct<episode_bytes:bigint,assets_referenced_bytes:bigint,assets_new_bytes:bigint>, "
                 f"seconds double, rss_mb double, index_row struct<{EPISODE_INDEX.replace(' ', ':').replace(',:', ',')}>, "
                 f"index_rows array<struct<{EPISODE_INDEX.replace(' ', ':').replace(',:', ',')}>>")
LEDGER = ("id string, family string, path string, local_path string, sha256_verified string, sha256_source string, bytes bigint, fetched_at string, "
          "verified_by array<string>, stripped struct<path:string,sha256:string>")

# Allowed enums of the canonical tables.
REGIMES = ("tabletop", "mobile_manipulation", "navigation")
OBJECT_ROLES = ("manipulated", "support", "receptacle", "fixture")
BODY_PARTS = ("left_arm", "right_arm", "head", "base")
INT_COLUMNS = ("size", "offset", "stored_size", "inflated_size", "crc32", "archive_size")


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
