import random

from lapidary.llm import quotes


def words(text):
    return " ".join(text.lower().split())


def read(text):
    """own words, (level, passage, its lines) of each quotation, and all that the message says, by a reading of its own."""
    lines = []
    for line in text.split("\n"):
        level, rest = 0, line
        while rest.lstrip(" \t").startswith(">"):
            level, rest = level + 1, rest.lstrip(" \t")[1:]
            rest = rest[1:] if rest[:1] in (" ", "\t") else rest
        lines.append((level, rest if level else line))
    runs = []
    for level, line in lines:
        if not runs or runs[-1][0] != level:
            runs.append((level, []))
        runs[-1][1].append(line)
    for i in range(len(runs) - 1):
        own = [x for x in runs[i][1] if x.strip()]
        if runs[i + 1][0] > runs[i][0] and own and own[-1].rstrip().endswith("wrote:"):
            while runs[i][1].pop().rstrip() != own[-1].rstrip():
                pass
    runs = [r for r in runs if r[1]]
    flat = [x for level, own in runs if level == 0 for x in own]
    said = {words(" ".join(flat)), *map(words, flat)}
    for level, own in runs:
        said |= {words(" ".join(p.split("\0"))) for p in "\0".join(x if x.strip() else "" for x in own).split("\0\0")} if level == 0 else set()
    found = [(level, words(" ".join(own)), [words(x) for x in own if words(x)]) for level, own in runs if level and words(" ".join(own))]
    return {"own": "\n".join(flat).strip() if found else text, "quotes": [{"level": a, "hash": b, "lines": c} for a, b, c in found], "said": said - {""}}


def brute(rows):
    """By direct search, for messages with unique keys."""
    info = {}
    for conv, turn, _, text in rows:
        info[conv, turn] = read(text or "")
    for conv, turn, role, text in rows:
        if conv is None or turn is None:
            yield conv, turn, role, info[conv, turn]["own"], len(info[conv, turn]["quotes"]), 0, None, None, conv, turn, 0, 0
            continue
        own, linked, reply = info[conv, turn], 0, None

        def original(h, conv=conv, turn=turn):
            keyed = [k for k in info if None not in k and h in info[k]["said"]]
            same = [k for k in keyed if k[0] == conv and k[1] < turn]
            first = min(keyed, default=None)
            return max(same) if same else first if first and first < (conv, turn) else None

        for q in own["quotes"]:
            to = original(q["hash"])
            found = [to] if to else [t for h in q["lines"] if (t := original(h))]
            linked += bool(found)
            if found and q["level"] == 1 and reply is None:
                reply = found[0]
        info[conv, turn]["reply"] = reply
        info[conv, turn]["row"] = (conv, turn, role, own["own"], len(own["quotes"]), linked)
    answers = {}
    for key in info:
        if None not in key:
            answers.setdefault(info[key]["reply"], []).append(key)

    def walk(key):
        yield key
        for answer in sorted(answers.get(key, ())):
            yield from walk(answer)

    for conv, turn, _, _ in rows:
        if conv is None or turn is None:
            continue
        root, depth = (conv, turn), 0
        while info[root]["reply"]:
            root, depth = info[root]["reply"], depth + 1
        reply = info[conv, turn]["reply"] or (None, None)
        yield (*info[conv, turn]["row"], *reply, *root, depth, list(walk(root)).index((conv, turn)))


def made():
    rng = random.Random(14)
    vocabulary = [f"word{i}" for i in range(60)] + ["Straße", "日本"]
    say = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 6)))
    rows, common = [], "Hello there"
    for conv in range(12):
        earlier = []
        for turn in range(rng.randint(1, 9)):
            body = [rng.choice([say(), common, say() + "\n" + say(), say() + "\n\n" + say()])]
            pool = earlier + [r[3] for r in rows[:20]]
            for _ in range(rng.randint(0, 2) if pool else 0):
                source = rng.choice(pool)
                part = rng.choice([source, source.split("\n")[0], source.split("\n\n")[-1], say()])
                quoted = "\n".join(rng.choice([">", "> "]) + x for x in part.split("\n"))
                body.insert(0, rng.choice(["", "On Monday Ann wrote:\n"]) + quoted)
            text = "\n".join(body)
            rows.append((conv, turn * 2, rng.choice(["user", "assistant"]), text))
            earlier.append(text)
    return rows + [(50, 0, "user", None), (50, 1, None, ""), (None, 3, "user", "> " + common), (51, None, "user", common), (52, 0, "user", ">> deep\n> shallow\nme " + "x " * 20_000)]


def test_against_direct_search(spark):
    rows = made()
    frame = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)
    got = quotes.linked_messages(frame).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(x) for x in brute(rows))
    assert any(r.depth > 1 for r in got) and any(r.n_linked for r in got)


def test_order_repeats_and_empty_table(spark):
    rows = [(1, 0, "user", "first"), (1, 1, "user", "second"), (1, 2, "user", "> first\nthird"), (1, 2, "user", "> first\nthird")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [r.text for r in quotes.reply_ordered(frame).collect()] == ["first", "third", "third", "second"]
    deep = [(1, 0, "user", "root"), (1, 1, "user", "> root\nA"), (1, 2, "user", "> root\nB"), (1, 3, "user", "> A\nC"), (1, 4, "user", "> C\nD"), (1, 5, "user", "> B\nE")]
    deep += [(2, i, "user", f"> m{i - 1}\nm{i}" if i else "m0") for i in range(40)]
    got = quotes.reply_ordered(spark.createDataFrame(deep, frame.schema)).collect()
    assert [r.text for r in got] == ["root", "A", "C", "D", "B", "E", *(f"m{i}" for i in range(40))] and got[-1].depth == 39
    assert quotes.linked_messages(frame.limit(0)).collect() == []


def test_levels_and_announcements():
    text = "Ann wrote:\n> Bob wrote:\n>> old\n> new\nmine\n"
    found = quotes.parsed(text)
    assert [q["level"] for q in found["quotes"]] == [2, 1] and found["own"] == "mine"
    for _, _, _, text in made():
        mine, its = read(text or ""), quotes.parsed(text or "")
        assert its["own"] == mine["own"] and sorted(its["said"]) == sorted(map(quotes.digest, mine["said"]))
        assert its["quotes"] == [{"level": q["level"], "hash": quotes.digest(q["hash"]), "lines": list(map(quotes.digest, q["lines"]))} for q in mine["quotes"]]
