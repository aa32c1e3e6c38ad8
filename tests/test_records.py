"""Prose, compact views and audits against plain versions and planted faults."""

import json
import random
import re

from engramflow.operators import audits, records

LANGS = ("zh-CN", "ja", "en", "zh-TW", "th", "unknown")


def split_records(text):
    head, found = [], []
    for line in text.splitlines():
        if line.startswith("[record:"):
            found.append([line])
        elif found:
            found[-1].append(line)
        else:
            head.append(line)
    return head, found


def plain_prose(text):
    _, found = split_records(text)
    if not found:
        return text.strip()
    out = []
    for lines in found:
        if "[document_role: front_matter]" in lines:
            continue
        said = [re.sub(records.PREFIX, "", x).strip() for x in lines if x.strip() and not x.lstrip().startswith("[")]
        said = [x for x in said if x]
        names = [x[13:-1].strip() for x in lines if x.startswith("[speaker_raw:") and x.endswith("]")]
        if said:
            named = names and names[0] and names[0].casefold() not in records.NOBODY
            out.append((f"{names[0]}: " if named else "") + "\n".join(said))
    return "\n\n".join(out).strip()


def plain_korean(script):
    clean = lambda x: " ".join(re.sub(r"\[/?ruby[^\]]*\]|\[(?:[0-9A-Fa-f]{6}|-)\]", "", x).split())
    cells = script.split(";")
    if script.startswith("#na;") and len(cells) > 2 and clean(";".join(cells[2:])):
        return clean(";".join(cells[2:]))
    if len(cells) > 3 and cells[0].isdigit() and clean(";".join(cells[3:])):
        return clean(";".join(cells[3:]))
    return clean(";".join(cells[1:])) if script.startswith(("#title;", "#place;")) else ""


def plain_compact(text):
    head, found = split_records(text)
    if not found:
        return text
    views = []
    for lines in found:
        view = [x for x in lines if x.startswith(records.KEPT)]
        if not any(x.strip().casefold() == "[document_style: reference]" for x in view) and not any(x.startswith("[speaker_raw:") for x in view):
            view.append("[speaker_raw: ???]")
        said, now = {}, ""
        for x in lines:
            lang = next((n for n in LANGS if x.startswith(n + ":")), "")
            if lang:
                said[lang], now = [x[len(lang) + 1 :].lstrip()], lang
            elif x.startswith("["):
                now = ""
            elif now and x.strip():
                said[now].append(x)
        chosen = [n for n in LANGS[:3] if n in said] or [n for n in LANGS[3:] if n in said][:1]
        view += [f"{n}: " + "\n".join(said[n]) for n in chosen]
        script = next((x for x in lines if x.startswith("[script_raw:")), "")
        korean = plain_korean(script[12:].removesuffix("]").strip()) if script else ""
        views.append("\n".join(view + ([f"ko: {korean}"] if korean else [])))
    return "\n".join(head).rstrip() + "\n\n" + "\n\n".join(views)


PARTS = ["[record: 1]", "[record: 22]", "[speaker_raw: Ann]", "[speaker_raw:  ??? ]", "[speaker_raw: ]", "[document_role: front_matter]", "[document_style: Reference] ", "[epistemic_note: x]", "[other: y]", "en: hello", "en:", "ja:  konnichi", "zh-TW: a", "th: b", "unknown: c", "EN: upper", "ko: d",
         "more", "", "  ", "  [inside]", "\ttabbed ", "[script_raw: #na;x;[ruby=k]han[/ruby] [ff00AA]x[-] [USERNAME]]", "[script_raw: 3;a;b;text;more]", "[script_raw: #title;T]", "[script_raw: #na;x;]"]


def texts():
    rng = random.Random(9)
    out = ["", "plain\n\ntext ", "[record: 1]", None, "head\n\n[record: 1]\nen: a\r\nb c\x0bd\n", " x " * 3000]
    return out + [rng.choice(["\n", "\n", "\r\n"]).join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(250)]


def test_prose_and_compact(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, text string, TEXT2 string")
    assert {r.id: r.text for r in records.prose(df).collect()} == {i: plain_prose(t or "") for i, t in rows}
    assert {r.id: r.text for r in records.compact(df).collect()} == {i: None if t is None else plain_compact(t) for i, t in rows}
    assert records.compact(df.limit(0)).count() == 0 and records.prose(df.limit(0)).count() == 0


def test_planted_faults_of_evidence(spark):
    text = "[record: 1]\n[speaker_raw: Ann]\nen: Hello Bob\nsecond line\n\n[record: 2]\nja: x\nen: last"
    lines = [x for x in plain_compact(text).splitlines() if x.strip()]
    good = lambda a, b: "\n".join(lines[a - 1 : b])
    j = json.dumps
    rows = [
        (1, 7, audits.BASIS, j([good(1, 2), good(3, 4)]), j([[1, 2], [3, 4]]), j(["Ann", "BOB / ???", " "])),
        (2, 7, audits.BASIS, j([good(1, 2), "other"]), j([[1, 2], [3, 4]]), j(["Zed", "Ann (Zed)"])),
        (3, 7, audits.BASIS, j([good(1, 2), "x"]), j([[1, 2], [3, 99]]), j(["Zed"])),
        (4, 7, audits.BASIS, j([good(1, 2)]), j([[1, 2], [3, 4]]), "[]"),
        (5, 7, audits.BASIS, "[]", "[]", "[]"),
        (6, 7, audits.BASIS, j([" "]), j([[1, 2]]), "[]"),
        (7, 7, audits.BASIS, j(["a"]), j([[1, True]]), "[]"),
        (8, 7, audits.BASIS, "oops", j([[1, 2]]), "[]"),
        (9, 7, audits.NONE, "[]", "[]", "[]"),
        (10, 7, "else", "[]", "[]", "[]"),
        (11, 7, None, j(["a", 3]), j([[1, 2]]), None),
        (12, 99, audits.BASIS, j(["a"]), j([[1, 1]]), "oops"),
        (13, 7, audits.BASIS, j(["a"]), j([[2, 1]]), "[]"),
        (14, 7, audits.BASIS, None, j([[1, 2, 3]]), "[]"),
    ]
    episodes = spark.createDataFrame(rows, "id long, source_id long, basis string, quotes_json string, spans_json string, participants_json string")
    sources = spark.createDataFrame([(7, text), (8, "unused")], "id long, text string")
    got = sorted((int(r.key), r.check, r.reason) for r in audits.evidence(episodes, sources).collect())
    bad = "invalid_evidence_json"
    assert got == sorted([
        (2, "evidence", "evidence_quote_does_not_match_span"), (2, "participants", "participant_not_in_evidence"), (2, "participants", "participant_not_in_evidence"), (3, "evidence", "evidence_span_out_of_range"),
        (4, "evidence", "evidence_quote_span_count_mismatch"), (5, "evidence", "evidence_quote_span_count_mismatch"), (6, "evidence", bad), (7, "evidence", bad), (8, "evidence", bad),
        (9, "evidence", "evidence_required_but_unavailable"), (10, "evidence", "unsupported_evidence_basis"), (11, "evidence", bad), (12, "evidence", "evidence_span_out_of_range"), (13, "evidence", "evidence_span_out_of_range"), (14, "evidence", bad),
    ])
    assert "9" not in {r.key for r in audits.evidence(episodes, sources, required=False).collect()}
    assert sorted((int(r.key), r.detail) for r in audits.participants(episodes, sources).collect()) == [(2, "Ann (Zed)"), (2, "Zed"), (3, "Zed")]


def test_planted_faults_of_storage(spark):
    cues = [(1, "context", "d", 2, [0.6, 0.8]), (2, "need", "d", 2, [1.0, 0.0]), (3, "need", "e", 2, [1.0, 0.0, 0.0]), (4, "need", "d", 2, [2.0, 0.0]), (5, "other", "d", 2, None), (6, "context", "d", 2, [float("nan"), 1.0])]
    mode = "contextual_recall"
    edges = [
        (1, mode, 1, 2, "episode", 1, "retrieval_only"), (2, mode, 1, 3, "episode", 1, "retrieval_only"), (3, mode, 9, 2, "episode", 1, "retrieval_only"), (4, mode, 1, None, "episode", 1, "direct_fact"), (5, mode, 1, 2, "concept", 1, "retrieval_only"),
        (6, mode, 1, 2, "episode", 8, None), (7, mode, 1, 1, "episode", 1, "retrieval_only"), (8, "semantic", 9, 9, "x", 8, "direct_fact"), (9, mode, 2, 1, "episode", 1, "retrieval_only"), (10, mode, 1, 5, "episode", 1, "retrieval_only"), (11, mode, 9, 9, "episode", 1, "retrieval_only"),
    ]
    got = audits.storage(
        spark.createDataFrame(edges, "id long, mode string, context_cue_id long, need_cue_id long, to_type string, to_id long, claim_level string"),
        spark.createDataFrame(cues, "id long, kind string, domain string, dimension int, vector array<float>"),
        spark.createDataFrame([("episode", 1), ("concept", 1)], "type string, id long"),
    )
    assert sorted((r.check, int(r.key), r.reason) for r in got.collect()) == sorted([
        *[("cues", k, "invalid_vector") for k in (3, 4, 5, 6)], ("storage", 2, "cross_domain_edge"), ("storage", 3, "orphan_context_cue"), ("storage", 3, "invalid_cue_kind"), ("storage", 4, "orphan_need_cue"), ("storage", 4, "invalid_cue_kind"),
        ("storage", 4, "invalid_claim_level"), ("storage", 5, "invalid_target"), ("storage", 6, "invalid_target"), ("storage", 6, "invalid_claim_level"), ("storage", 7, "invalid_cue_kind"), ("storage", 10, "invalid_cue_kind"),
        ("storage", 11, "orphan_context_cue"), ("storage", 11, "orphan_need_cue"),
    ])
