"""The pN_ queries by name, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .clean import p4_clean, p4_found
from .language import p5_found, p5_segments
from .packing import p7_containers
from .pairs import p1_found, p1_pairs
from .pieces import p3_found, p3_pieces
from .quality import p8_found, p8_statistics
from .sentences import p2_found, p2_sentences
from .tokenizer import p6_ids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_sentences, p3_found, p3_pieces, p4_found, p4_clean, p5_found, p5_segments, p6_ids, p7_containers, p8_found, p8_statistics)
}

SQL: dict[str, str] = {
    "p3_found": r"""
        WITH normal AS (
            SELECT file_id, regexp_replace(regexp_replace(content, '^\x{feff}', ''), '\r\n?', chr(10), 'g') AS t FROM files),
        size AS (SELECT max(capacity) AS capacity FROM size_limits WHERE item = 'piece'),
        long AS (SELECT DISTINCT file_id, t, capacity FROM normal, size WHERE length(t) > capacity)
        SELECT DISTINCT file_id,
               CASE WHEN list_max(list_transform(
                        string_split_regex(t, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}.!?…。！？]+'), lambda x: length(x))) > capacity
                    THEN 'hard_cut' ELSE 'cut' END AS need
        FROM long
    """,
}
