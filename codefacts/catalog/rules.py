"""The scope rules used by the registered queries: two ignore patterns and one library."""

from __future__ import annotations

from codefacts.projection import PROJECT, Facts

SCHEMA = "project_id string, kind string, ord int, pattern string, name string"
RULES = [
    (PROJECT, "ignore", 1, "App/Brand_1/**", None),
    (PROJECT, "ignore", 2, "*_6.h", None),
    (PROJECT, "third_party", 3, "Middlewares/LVGL/**", "lvgl-lib"),
]


def rules(f: Facts, extra: list[tuple] | None = None):
    return f.spark.createDataFrame(RULES + (extra or []), SCHEMA)
