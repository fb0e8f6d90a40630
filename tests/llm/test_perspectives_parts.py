"""Parts hold at most PART messages whatever the turns and ids are, and repeats without an id or a turn stand."""

from basketry.llm import chat_perspectives


def test_parts_and_repeats(spark):
    rows = [(None, t % 3, "user" if t % 2 else "bot", f"x{t}") for t in range(300)]
    rows += [(None, 1, "user", "again")] * 5 + [(7, None, "user", "hm")] * 3 + [(7, 2, "bot", "ok")] * 4 + [(7, -1, "bot", "é first")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = chat_perspectives.rotate_perspectives(turns).collect()
    assert max(r.n_messages for r in got) <= chat_perspectives.PART
    whole = {}
    for r in sorted(got, key=lambda r: (r.conv_id or 0, r.speaker, r.part)):
        text = whole.get((r.conv_id, r.speaker), "")
        assert r.start == len(text) and r.n_own == len(r["mask"])
        whole[r.conv_id, r.speaker] = text + r.text
    want = {None: sorted((r for r in rows if r[0] is None), key=lambda r: r[1:])}
    want[7] = [(7, -1, "bot", "é first"), (7, 2, "bot", "ok")] + [(7, None, "user", "hm")] * 3
    heads = {True: lambda r: "<|im_start|>assistant\n", False: lambda r: f"<|im_start|>user name={r}\n"}
    assert whole == {
        (c, s): "".join(heads[r == s](r) + t + "<|im_end|>\n" for _, _, r, t in lines)
        for c, lines in want.items()
        for s in ("bot", "user")
    }
