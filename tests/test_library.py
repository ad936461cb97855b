"""Libraries of song maps read again: only what changed is opened."""

import json
import os

from cadenza.sources import documents as D, library as L
from cadenza.sources.versions import Versions


def put(path, name, content, at=1_700_000_000):
    f = path / name
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_text(content)
    os.utime(f, (at, at))


def song(n):
    return json.dumps({"video": f"v{n}", "duration": float(n), "notes": [{"x0": 1, "t_start": 0.5, "midi": 60}] * n}, ensure_ascii=False)


def test_only_changes_are_read(spark, tmp_path):
    src = tmp_path / "maps"
    for i in range(4):
        put(src, f"a/song_map_s{i}.json", song(i))
    put(src, "b/odd [1] ünï.json", song(7))
    put(src, "b/broken.json", '{"video": ')
    put(src, "b/empty.json", "")
    put(src, "b/other.txt", "no map")
    maps, bad = Versions(spark, f"file://{tmp_path}/t/maps", L.MAPS, buckets=4), Versions(spark, f"file://{tmp_path}/t/bad", L.QUARANTINE, buckets=4)
    refresh = lambda: L.refresh(spark, f"file://{src}", maps, bad)
    have = lambda: {r.song_id: (r.map.duration, len(r.map.notes or [])) for r in maps.read().collect()}
    assert refresh() == {"parsed": 5, "set aside": 1, "gone": 0}
    assert have() == {f"s{i}": (i, i) for i in range(4)} | {"odd [1] ünï": (7, 7)}
    assert sorted((r.path.rsplit("/", 1)[1], r.reason, r.content) for r in bad.read().collect()) == [("broken.json", "not a song map", '{"video": ')]
    versions = maps.versions(), bad.versions()
    assert refresh() == {"parsed": 0, "set aside": 0, "gone": 0} and (maps.versions(), bad.versions()) == versions
    put(src, "a/song_map_s1.json", song(9), 1_700_000_100)  # changed
    put(src, "b/broken.json", song(5), 1_700_000_100)  # mended
    put(src, "a/song_map_s2.json", "[", 1_700_000_100)  # broken
    put(src, "c/new.json", song(6))
    os.remove(src / "a/song_map_s3.json")
    put(src, "b/odd [1] ünï.json", "", 1_700_000_100)  # empty
    assert refresh() == {"parsed": 3, "set aside": 1, "gone": 2}
    assert have() == {"s0": (0, 0), "s1": (9, 9), "broken": (5, 5), "new": (6, 6)}
    assert [r.path.rsplit("/", 1)[1] for r in bad.read().collect()] == ["song_map_s2.json"]
    assert refresh() == {"parsed": 0, "set aside": 0, "gone": 0}


def test_new_folders_before_legacy_ones(spark, tmp_path):
    for name, n, at in (("old/song_map_v1.json", 1, 5000), ("new/v1.json", 2, 1000), ("old/song_map_v2.json", 3, 1000), ("new/x.json", 4, 1000), ("new/copy/x.json", 5, 9000)):
        put(tmp_path / "m", name, song(n), 1_700_000_000 + at)
    maps, bad = Versions(spark, f"file://{tmp_path}/t/maps", L.MAPS), Versions(spark, f"file://{tmp_path}/t/bad", L.QUARANTINE)
    L.refresh(spark, f"file://{tmp_path}/m", maps, bad)
    assert [(r.song_id, r.map.duration) for r in L.current(maps.read(), "/old/").collect()] == [("v1", 2), ("x", 5), ("v2", 3)]


def test_songs_of_info_documents(spark, tmp_path):
    title = "【カラオケ練習用】みどりの丘／山田うた｜[Videoke] Green Hill - Uta Yamada - カラオケ@DIVA"
    put(tmp_path, "s1/video.info.json", json.dumps({"id": "abc", "title": title, "channel": "カラオケ@DIVA", "duration": 201.5, "more": [1]}))
    put(tmp_path, "s2/video.info.json", json.dumps({"id": "def", "title": "t" * 200, "channel": "", "uploader": "someone"}))
    put(tmp_path, "s3/video.info.json", "{")
    got = {r.song_id: tuple(r)[1:] for r in D.songs_of_info(spark, f"file://{tmp_path}").collect()}
    assert got["s1"] == ("みどりの丘", "山田うた", "Green Hill", "Uta Yamada", 201.5, "abc", True)
    assert got["s2"] == ("t" * 120, "someone", None, None, None, "def", False)
    assert got["s3"][4:] == (None, None, False)


def test_edits_by_hand(spark, tmp_path):
    from pyspark.sql import functions as F

    for i in (1, 2):
        put(tmp_path / "m", f"s{i}.json", song(i))
    maps, bad = Versions(spark, f"file://{tmp_path}/t/maps", L.MAPS, buckets=4), Versions(spark, f"file://{tmp_path}/t/bad", L.QUARANTINE, buckets=4)
    L.refresh(spark, f"file://{tmp_path}/m", maps, bad)
    original = maps.commit_of()["version"]
    notes = [(2.0, 3.0, "auto"), (0.0, 2.5, "manual"), (2.98, 4.0, "manual"), (5.0, 6.0, None)]
    pages = [(0.00049, 5.0, 100.04567, 0.123456), (5.00051, 9.0, None, None)]
    edits = spark.createDataFrame([("s1", notes, pages), ("s9", notes, pages)], "song_id string, n array<struct<a:double,b:double,s:string>>, p array<struct<a:double,b:double,r:double,t:double>>")
    kind = {f: dict((n, t) for n, t in L.FIELDS)[f] for f in ("notes", "pages")}
    own = F.transform("n", lambda x: F.from_json(F.lit("{}"), kind["notes"][6:-1]).withField("t_start", x["a"]).withField("t_end", x["b"]).withField("src", x["s"]))
    edits = edits.select("song_id", own.alias("notes"), F.transform("p", lambda x: F.struct(x["a"].alias("vis_a"), x["b"].alias("t_end"), x["r"].alias("R"), x["t"].alias("T0"))).alias("pages"))
    for _ in range(2):
        L.save(maps, edits, "editor", 0)
    L.save(maps, edits, "editor", 1)
    got = {r.song_id: r.map for r in maps.read().collect()}
    assert got.keys() == {"s1", "s2"} and got["s2"].n_manual is None and len(got["s2"].notes) == 2
    m = got["s1"]
    assert [(n.t_start, n.t_end, n.src) for n in m.notes] == [(0.0, 1.99, "manual"), (2.0, 2.97, "auto"), (2.98, 4.0, "manual"), (5.0, 6.0, None)]
    assert (m.n_notes, m.n_pages, m.n_manual, m.method, m.page_flips, m.video) == (4, 2, 2, "+manual", [5.001], "v1")
    assert [tuple(p) for p in m.pages] == [(0.0, 5.0, 100.046, 0.1235), (5.001, 9.0, None, None)]
    assert {r.song_id: r.map.n_manual for r in maps.read(original).collect()} == {"s1": None, "s2": None} and maps.versions()[-1] == original + 2
    assert L.refresh(spark, f"file://{tmp_path}/m", maps, bad)["parsed"] == 0  # the files are as they were
