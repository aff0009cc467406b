"""Tables the archive has but the test data lacks, derived from the given ones by SQL both engines read.

Each text is a SELECT over the given tables; Spark registers them as views, the SQL twins open with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fotoloom.session import load

GIVEN = ["photo_index", "faces", "person", "person_relation", "tag", "photo_tag", "app_user", "orders", "lineitem", "events", "documents"]
SQL = {
    "album": """SELECT o_orderkey AS album_id, 1 + o_custkey % 200 AS user_id, concat('Album ', CAST(o_orderkey AS STRING)) AS title,
 o_orderstatus = 'F' AS is_public, o_orderdate AS updated_at FROM orders""",
    "album_photo": """SELECT l_orderkey AS album_id, 1 + l_partkey AS image_id, min(l_linenumber) AS sort_order, max(l_shipdate) AS added_at
 FROM lineitem GROUP BY l_orderkey, 1 + l_partkey""",
    "album_cover": "SELECT l_orderkey AS album_id, min(1 + l_partkey) AS cover_image_id FROM lineitem GROUP BY l_orderkey",
    "scan_old": "SELECT file_path, file_size AS size FROM photo_index WHERE image_id % 10 <> 0",
    "scan_new": "SELECT file_path, CASE WHEN image_id % 8 = 0 THEN file_size + 1 ELSE file_size END AS size FROM photo_index WHERE image_id % 10 <> 1",
    "change_log": """SELECT user_id AS file_key, event_id AS usn,
 CASE event_type WHEN 'click' THEN 'CREATE' WHEN 'error' THEN 'DELETE' ELSE 'MODIFY' END AS reason FROM events""",
    "section": """SELECT * FROM (VALUES ('search', true, false), ('map', true, false), ('help', true, false), ('faces', false, false), ('albums', false, false),
 ('tags', false, false), ('admin', false, true), ('users', false, true)) AS t(section_code, is_public, admin_only)""",
    "api_function": """SELECT * FROM (VALUES ('search.text', 'search'), ('map.view', 'map'), ('faces.assign', 'faces'), ('faces.view', 'faces'),
 ('albums.edit', 'albums'), ('albums.view', 'albums'), ('tags.edit', 'tags'), ('admin.index', 'admin'), ('users.edit', 'users')) AS t(function_code, section_code)""",
    "grants": "SELECT user_id, 'faces.view' AS function_code FROM app_user WHERE user_id % 3 = 0 UNION ALL SELECT user_id, 'albums.view' FROM app_user WHERE user_id % 2 = 0",
}


class Tables:
    """Given and derived tables of one data folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in SQL:
            return self.spark.sql(self._bound(SQL[name]))
        return load(self.spark, self.dir, name)

    def _bound(self, sql: str) -> str:
        for t in GIVEN:
            for word in ("FROM", "JOIN"):
                sql = sql.replace(f"{word} {t} ", f"{word} parquet.`{self.dir}/{t}.parquet` ").replace(f"{word} {t}\n", f"{word} parquet.`{self.dir}/{t}.parquet`\n")
                if sql.endswith(f"{word} {t}"):
                    sql = sql[: -len(t)] + f"parquet.`{self.dir}/{t}.parquet`"
        return sql


def ctes(*names: str) -> str:
    """The derived tables as the start of a SQL text."""
    return "WITH " + ",\n ".join(f"{n} AS ({SQL[n]})" for n in names)
