"""A live playlist that grows between batches, a restart, and lists that can't be loaded at first."""

import threading
import time

from tidemark.streaming import live


def write(path, first, n, ended=False):
    lines = ["#EXTM3U", "#EXT-X-TARGETDURATION:1", f"#EXT-X-MEDIA-SEQUENCE:{first}", '#EXT-X-KEY:METHOD=AES-128,URI="k"']
    lines += [x for i in range(first, first + n) for x in (f"#EXTINF:{i}.5,", f"{i}.ts")] + (["#EXT-X-ENDLIST"] if ended else [])
    new = path.with_suffix(".new")
    new.write_text("\n".join(lines))
    new.rename(path)


def test_extent():
    assert live.extent("#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:7\r\n#EXTINF:1,\na\nb\n#EXTINF:2\n c ") == (7, 9, False, 0.0)
    assert live.extent("#EXTM3U\n#EXT-X-TARGETDURATION:6.5\n#EXT-X-ENDLIST") == (0, 0, True, 6.5)
    assert live.has_ended(None) is False and live.has_ended({"sources": [{"endOffset": '{"a": [3, true], "b": [1, false]}'}]}) is False


def test_growing_lists_and_restart(spark, tmp_path):
    a, b = tmp_path / "a.m3u8", tmp_path / "b.m3u8"
    uris = [f"file://{a}", f"file://{b}"]
    write(a, 0, 3)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def grow():
        # When the first segments are there, the list slides, and the other one appears.
        while not list((tmp_path / "out").glob("batch=0/_SUCCESS")):
            time.sleep(0.1)
        write(a, 2, 3)
        write(b, 10, 2, True)

    helper = threading.Thread(target=grow)
    helper.start()
    assert live.follow(spark, uris, out, state, seconds=40) is False
    helper.join()
    seen = lambda: sorted((r.uri[-6], r.media_sequence, r.duration, r.key.method) for r in spark.read.parquet(out).collect())
    assert seen() == [("a", i, i + 0.5, "AES-128") for i in range(5)] + [("b", i, i + 0.5, "AES-128") for i in (10, 11)]
    # While nothing runs the list goes on and ends; the next run takes only what is new.
    write(a, 3, 5, True)
    assert live.follow(spark, uris, out, state, seconds=60) is True
    assert [x[1] for x in seen() if x[0] == "a"] == list(range(8)) and len(seen()) == 10


def test_running_list_is_entered_before_its_end(tmp_path):
    path = tmp_path / "c.m3u8"
    write(path, 0, 10)
    reader = live.Reader({"uris": f"file://{path}\nfile:///none", "behind": "6"})
    end = reader.latestOffset()
    (part,) = reader.partitions(reader.initialOffset(), end)
    assert end == {f"file://{path}": [10, False], "file:///none": [-1, False]} and part.rows[0][2:] == (4, 10, False)
    # Not loaded again before its wait is over, and never backwards.
    write(path, 0, 5)
    assert reader.latestOffset() == end
    reader.due = dict.fromkeys(reader.due, 0.0)
    assert reader.latestOffset() == end and reader.partitions(end, end)[0].rows == []
