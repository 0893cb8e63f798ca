"""Timeline files: the text of each form, and the one reader for both forms of documents."""

import json

import pytest

from tessera.sources import timelines as T

SCHEMA = "video string, actor string, emotion string, start double, end double, confidence double, actor_id int, track_ids array<int>, start_frame int, end_frame int, samples int, similarity double"
ROWS = [
    ("v1", "Ann", "joy", 2.0, 3.25, 0.98765, 7, [5, 3, 5], 50, 81, 4, 0.5),
    ("v1", "Bob", "calm, \"dry\"", 0.5, 0.25, 0.1, 8, [], 12, 6, 1, 0.12344),
    ("v2", "Ann", "joy", 1.0, 1.5, 0.4, 7, None, 25, 37, 2, 0.6),
]


@pytest.fixture
def events(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def lines(folder, ending):
    return [x for p in sorted(folder.rglob(f"*.{ending}")) for x in p.read_text().splitlines()]


def test_csv_forms(events, tmp_path):
    T.write_timeline(events, str(tmp_path / "a"), "csv", True)
    v1 = lines(tmp_path / "a" / "video=v1", "csv")
    assert v1 == [",".join(T.VERBOSE), r'Bob,8,"calm, \"dry\"",0.500,0.250,0.000,0.1000,0.1234,12,6,1,""', "Ann,7,joy,2.000,3.250,1.250,0.9877,0.5000,50,81,4,3|5"]
    T.write_timeline(events, str(tmp_path / "b"), "csv")
    assert lines(tmp_path / "b" / "video=v2", "csv") == [",".join(T.LEAN), "Ann,joy,1.000,1.500,0.500,0.4000"]
    back = {(r.video, r.actor): r for r in T.read_timeline_rows(events.sparkSession, str(tmp_path / "a"), True).collect()}
    assert back["v1", "Bob"].emotion == 'calm, "dry"' and back["v1", "Bob"].track_ids == [] and back["v1", "Ann"].track_ids == [3, 5] and back["v2", "Ann"].track_ids == []


def test_documents_of_both_forms(events, tmp_path):
    videos = events.sparkSession.createDataFrame([("v1", 10.0, 25.0), ("v2", 4.0, 30.0)], "video string, video_duration double, fps double")
    T.write_timeline(events, str(tmp_path / "lean"), "json", False, videos)
    T.write_timeline(events, str(tmp_path / "full"), "json", True, videos)
    lean, full = ({d["video"]: d for d in map(json.loads, lines(tmp_path / k, "json"))} for k in ("lean", "full"))
    assert lean["v1"] == {"video": "v1", "video_duration": 10.0, "fps": 25.0, "events": [
        {"actor": "Bob", "emotion": 'calm, "dry"', "start": 0.5, "end": 0.25, "duration": 0.0, "confidence": 0.1},
        {"actor": "Ann", "emotion": "joy", "start": 2.0, "end": 3.25, "duration": 1.25, "confidence": 0.9877},
    ]}
    assert full["v1"]["video_info"] == {"path": "v1", "video_duration": 10.0, "fps": 25.0} and full["v1"]["events"][1]["track_ids"] == [3, 5]
    got = {(r.video, r.actor): r for r in T.read_timeline(events.sparkSession, str(tmp_path / "lean")).collect()}
    assert (got["v1", "Ann"].samples, got["v1", "Ann"].actor_id, got["v1", "Ann"].track_ids, got["v1", "Ann"].similarity) == (0, -1, [], 0.0)
    more = {(r.video, r.actor): r for r in T.read_timeline(events.sparkSession, str(tmp_path / "full")).collect()}
    assert (more["v1", "Bob"].end_frame, more["v1", "Bob"].similarity, more["v2", "Ann"].fps, more["v2", "Ann"].track_ids) == (6, 0.1234, 30.0, [])


def test_an_indented_document_of_another_writer(spark, tmp_path):
    lean = {"video": "clip.mp4", "video_duration": 9.5, "fps": 24.0, "analysis_time": "1.0 s", "actors": [], "events": [{"actor": "A", "emotion": "sad", "start": 1, "end": 2.5, "duration": 1.5}]}
    full = lean | {"video": "b.mp4", "video_info": {"path": "/in/b.mp4", "video_duration": 8.0, "fps": 30.0, "width": 4}, "events": [lean["events"][0] | {"confidence": 0.5, "track_ids": [2], "samples": 3}], "stats": {"x": 1}}
    for n, d in (("a", lean), ("b", full), ("c", {"video": "none.mp4", "events": []})):
        (tmp_path / f"{n}.json").write_text(json.dumps(d, indent=2))
    got = sorted((r.video, r.video_duration, r.fps, r.start, r.end, r.confidence, tuple(r.track_ids), r.samples) for r in T.read_timeline(spark, str(tmp_path), multiline=True).collect())
    assert got == [("/in/b.mp4", 8.0, 30.0, 1.0, 2.5, 0.5, (2,), 3), ("clip.mp4", 9.5, 24.0, 1.0, 2.5, 0.0, (), 0)]
