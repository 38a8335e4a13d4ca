"""A small world of tables with the dirt that the operators must bear, and an empty one."""

import datetime
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

BASE = "/root/testdata/sf0.001"
T0 = datetime.datetime(2025, 1, 1)
EN = "The keeper opened the door before noon. Nobody was there, so she went back to the house."
FR = "Le gardien a ouvert la porte avant midi. Personne n'était là, elle est donc rentrée à la maison."
DE = "Der Mann ging am Morgen auf den Markt und kaufte ein Brot. Am Abend war er nicht zu Hause."
ZH = "她在中午之前打开了门。没有人在那里，所以她回到屋里等其他人。"
LONG = "word " * 400_000  # two million characters

CONTENT = {
    1: EN, 2: EN, 3: EN, 4: EN + "\n" + EN, 5: EN, 6: None, 7: "", 8: " \n ", 9: LONG, 10: "x" * 9000, 11: EN + "\n" + DE, 12: "# Title\n\n- one\n- two\n\n```\n<b>x</b>\n```\n" + EN,
    13: "12345", 14: "1\r\n00:00:01,000 --> 00:00:02,000\r\n<i>" + EN + "</i>", 15: "﻿" + EN,
}
ANSWER = {1: FR, 2: "", 3: "I'm sorry, but I can't translate this text.", 4: FR, 5: EN, 9: LONG, 10: None, 12: ZH, 13: "12345", 14: None, 15: FR}


def files():
    rows = [dict(file_id=i, job_id="j", idx=i, name=f"n{i}.md", source_format=None, src_lang="en", target_language="法文", content=c, translated_content=ANSWER.get(i), text_eol=None, text_bom=None, source_sha256=None, received_at=T0) for i, c in CONTENT.items()]
    # Delivered again, and columns that clash with names inside the operators.
    rows += [r | {"received_at": T0 + datetime.timedelta(1)} for r in rows]
    return [r | {"lang": "x", "key": 1, "text": "y", "tokens": 3, "piece": 4, "shape": "z", "chunk": 5, "ids": 6, "traits": "t", "defect": "d", "_text": "u"} for r in rows]


def documents():
    texts = [EN, EN, None, "", " ", "﻿", LONG, "- a\n- b\n- c\n- d", "a;1;2\nb;3;4\nc;5;6", "0\n" * 40, ZH, DE, FR, "<|endoftext|> don't", "a" * 12_000, "\u2028\u2029\u00a0"]
    rows = [dict(doc_id=i + 1, text=t, lang={EN: "en", DE: "DE", FR: "fr", ZH: "zh"}.get(t), source=None, n_chars=None, name=f"d{i}", added_at=T0) for i, t in enumerate(texts)]
    return [r | {"key": 1, "tokens": 2, "ids": 3, "shape": "s", "words": 4, "part": 5, "container_id": 6, "bucket": 7} for r in rows]


def choices():
    rows = [dict(choice_id=i, job_id="j", file_id=i, line_no=0, attempt=1, content=ANSWER.get(i), finish_reason="stop", max_tokens=9, created_at=T0, arrived_at=T0) for i in CONTENT]
    rows += rows[:3] + [rows[0] | {"choice_id": 90, "attempt": None, "finish_reason": "length", "content": None, "line_no": None}, rows[0] | {"choice_id": 91, "file_id": None}]
    return [r | {"verdict": "v", "defect": "d"} for r in rows]


def write(folder, name, rows, schema=None):
    table = pa.Table.from_pylist(rows) if schema is None else pa.Table.from_pylist(rows, schema=schema)
    pq.write_table(table, f"{folder}/{name}.parquet")


@pytest.fixture(scope="session")
def world(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("world"))
    for name, rows in (("files", files()), ("documents", documents()), ("choices", choices()), ("sentence_set", [{"file_id": i} for i in [*CONTENT, 1]])):
        schema = pa.Table.from_pylist(rows).schema
        for column in ("source_format", "text_eol", "source_sha256", "source", "lang"):
            if (k := schema.get_field_index(column)) >= 0 and pa.types.is_null(schema.field(k).type):
                schema = schema.set(k, pa.field(column, pa.string()))
        for column, kind in (("text_bom", pa.bool_()), ("n_chars", pa.int64())):
            if (k := schema.get_field_index(column)) >= 0:
                schema = schema.set(k, pa.field(column, kind))
        write(folder, name, rows, schema)
    for name in ("languages", "common_words", "size_limits"):
        os.symlink(f"{BASE}/{name}.parquet", f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("files", "documents", "choices", "sentence_set"):
        pq.write_table(pq.read_table(f"{BASE}/{name}.parquet").slice(0, 0), f"{folder}/{name}.parquet")
    for name in ("languages", "common_words", "size_limits"):
        os.symlink(f"{BASE}/{name}.parquet", f"{folder}/{name}.parquet")
    return folder
