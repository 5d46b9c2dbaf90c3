import random

import pytest

from tillwise.llm import quotations as Q

SCHEMA = "conv_id long, turn long, role string, text string, level int, hash string, lines string, own string, thread int"


def frame(spark, rows):
    return spark.createDataFrame([(*row, 1, "h", "l", "o", 2) for row in rows], SCHEMA)


def quoted(text, level=1):
    return "\n".join(">" * level + " " + line for line in text.split("\n"))


def by_turn(found):
    return {(r.conv_id, r.turn): r for r in found.collect()}


def test_levels_passages_and_threads(spark):
    first, other = "Hello there.\nHow are you?", "Something else entirely"
    second = f"Ann wrote:\n{quoted(first)}\nFine, thanks.\nAnd you?"
    third = f"{quoted('Fine, thanks.')}\n{quoted(first, 2)}\nGood."
    rows = [
        (1, 0, "user", first),
        (1, 1, "user", other),
        (1, 2, "user", second),
        (1, 3, "user", third),
        (1, 4, "user", "> >   HOW  are YOU?  \n > something ELSE\n> entirely\n\n\nYes."),
        (1, 5, "user", "> nobody said this\nHm."),
        (1, 6, "user", "> Good."),
        (2, 0, "user", "> Hello there.\nother conversation"),
        (2, 1, None, None),
    ]
    got = by_turn(Q.conversations(frame(spark, rows)))
    assert len(got) == len(rows)
    pick = lambda name: [got[r[0], r[1]][name] for r in rows]
    assert pick("reply_to") == [None, None, 0, 2, 1, None, 3, None, None]
    assert pick("thread") == [0, 1, 0, 0, 1, 5, 0, 0, 1]
    assert pick("depth") == [0, 0, 1, 2, 1, 0, 3, 0, 0]
    assert pick("text") == [first, other, "Fine, thanks.\nAnd you?", "Good.", "Yes.", "Hm.", "", "other conversation", None]


def test_nearest_earlier_message_is_linked_and_later_ones_never(spark):
    rows = [(1, k, "user", "same words") for k in (0, 3, 2500, 9000)]
    rows += [(1, k, "user", "> same words") for k in (1, 3, 5, 2400, 2501, 8999, 9001)] + [(1, -5, "user", "> same words")]
    got = Q.conversations(frame(spark, rows)).where("n_quotes > 0 and text = ''").collect()
    assert sorted((r.turn, r.reply_to) for r in got) == sorted(
        {-5: None, 1: 0, 3: 0, 5: 3, 2400: 3, 2501: 2500, 8999: 2500, 9001: 9000}.items()
    )


def brute(rows):
    """Parents by definition for messages whose quotes are whole lines of level 1."""
    out = {}
    for conv, turn, _, text in rows:
        score = {}
        quotes = {line[2:] for line in text.split("\n") if line.startswith("> ")}
        whole = " ".join(line[2:] for line in text.split("\n") if line.startswith("> "))
        for piece in quotes | ({whole} if whole else set()):
            said = [
                t
                for c, t, _, x in rows
                if c == conv and t < turn
                and piece in {*(own := [y for y in x.split("\n") if not y.startswith("> ")]), " ".join(own)}
            ]
            if said:
                score[max(said)] = score.get(max(said), 0) + len(piece)
        out[conv, turn] = max(score, key=lambda t: (score[t], t)) if score else None
    return out


def test_random_conversations_match_brute_force(spark):
    rng, rows = random.Random(8), []
    for conv in range(6):
        said = []
        for turn in range(40):
            own = [f"line {rng.randint(0, 60)} of talk" for _ in range(rng.randint(1, 3))]
            source = rng.choice(said) if said and rng.random() < 0.6 else []
            rows.append((conv, turn, "user", "\n".join([f"> {x}" for x in source] + own)))
            said.append(own)
    got, parents = by_turn(Q.conversations(frame(spark, rows))), brute(rows)
    assert {key: row.reply_to for key, row in got.items()} == parents
    for key, row in got.items():
        depth, at = 0, key[1]
        while parents[key[0], at] is not None:
            depth, at = depth + 1, parents[key[0], at]
        assert (row.thread, row.depth) == (at, depth)
    ordered = Q.in_order(Q.conversations(frame(spark, rows))).collect()
    assert [(r.conv_id, r.position) for r in ordered] == [(conv, k) for conv in range(6) for k in range(40)]
    assert [(r.conv_id, r.thread, r.turn) for r in ordered] == sorted((c, got[c, t].thread, t) for c, t in got)
    seen = set()
    for row in ordered:
        assert row.reply_to is None or (row.conv_id, row.reply_to) in seen
        seen.add((row.conv_id, row.turn))


def test_wrapped_quote_of_two_of_three_paragraphs(spark):
    parts = [" ".join(f"{name}{k}" for k in range(30)) for name in ("one", "two", "three")]
    wrap = lambda part: "\n".join("> " + part[k] for k in range(len(part)))
    lines = [[" ".join(part.split()[k : k + 7]) for k in range(0, 30, 7)] for part in parts]
    rows = [(1, 0, "u", "\n\n".join(parts)), (1, 1, "u", "something else")]
    rows += [(1, 2 + k, "u", f"{wrap(lines[0])}\n{blank}\n{wrap(lines[1])}\nanswer {k}") for k, blank in enumerate((">", "> ", ">  \n>"))]
    got = by_turn(Q.conversations(frame(spark, rows)))
    assert [got[1, t].reply_to for t in range(5)] == [None, None, 0, 0, 0]
    assert all(got[1, t].n_linked == 2 and got[1, t].thread == 0 for t in (2, 3, 4))


def test_long_chains_of_answers(spark):
    rows = [(1, 0, "user", "words 0")] + [(1, k, "user", f"> words {k - 1}\nwords {k}") for k in range(1, 150)]
    got = by_turn(Q.conversations(frame(spark, rows)))
    assert all(r.thread == 0 and r.depth == t and (t == 0 or r.reply_to == t - 1) for (_, t), r in got.items())


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a"), (None, 2, "user", "> a\nb"), (3, None, "user", "> a\nc"), (4, 0, "user", ""), (4, 1, "u", ">\n> \n>>")]
    rows += [(5, 0, "user", "text"), (5, 0, "user", "text"), (5, 1, "user", "> text"), (5, 1, "user", "> text"), (5, 2, "x", "> " * 3000)]
    found = Q.conversations(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    assert all(r.reply_to is None for r in found if r.conv_id in (None, 3, 4))
    assert all((r.position is None) == (r.conv_id is None or r.turn is None) for r in found)
    assert sorted(r.position for r in found if r.conv_id == 5) == [0, 0, 1, 1, 2]
    assert [r.reply_to for r in found if (r.conv_id, r.turn) == (5, 1)] == [0, 0]
    assert next(r for r in found if r.conv_id == 4 and r.turn == 1).text == ""


def test_lines_of_very_many_marks(spark):
    rows = [(1, 0, "user", ">" * 200_000), (1, 1, "user", "> " * 100_000 + "x\nown"), (1, 2, "user", " \t" * 100_000 + "own")]
    found = by_turn(Q.conversations(frame(spark, rows)))
    assert [found[1, k].text for k in range(3)] == ["", "own", " \t" * 100_000 + "own"]


@pytest.mark.parametrize("mark", ["> ", ">", " > ", "\t>"])
def test_ways_to_mark_a_quote(spark, mark):
    rows = [(1, 0, "u", "First line\r\nsecond line"), (1, 1, "u", f"{mark}First line\r\n{mark}second line\r\nanswer")]
    got = by_turn(Q.conversations(frame(spark, rows)))
    assert got[1, 1].reply_to == 0 and got[1, 1].text == "answer"


def test_empty_table(spark):
    assert Q.conversations(frame(spark, [])).count() == 0
