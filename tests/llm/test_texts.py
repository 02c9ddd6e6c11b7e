"""Origins of files and languages of texts."""

import datetime

import pytest

from contextlake.llm import authored, languages

D = datetime.datetime(2024, 1, 1)
HAND = """export function sum(a, b) {
  if (!a) {
    throw new Error('no a');
  }
  // add
  const list = [a, b].filter(x => x > 0);
  for (const x of list) {
    log.info(x, 'seen');
  }
  while (list.length < 3) {
    list.push(0);
  }
  return list.map(x => x * 2).length + b;
}
"""
GENERATED = "\n".join(f"    case {i}: s = {i * 7}; t = {i + 3}; break;" for i in range(40))
MINIFIED = "".join(f"function a{i}(b,c){{return b.d{i}?c[{i}]:e(b)}}var f{i}=g({i});" for i in range(40))
DATA = "export const rows = [\n" + "\n".join(f"  [{i * 977}, {i}.25, 'abcdefgh{i}']," for i in range(60)) + "\n];"


def test_origins(spark):
    files = {
        1: ("src/a.js", HAND, "authored"),
        2: ("src/b.js", GENERATED, "generated"),
        3: ("src/c.js", MINIFIED, "minified"),
        4: ("src/d.js", DATA, "data"),
        5: ("p/vendor/x/a.js", HAND, "vendored"),
        6: ("p/vendors/a.js", HAND, "authored"),
        7: ("package-lock.json", "{}", "lock"),
        8: ("src/generated/a.js", HAND, "authored"),
        9: ("src/e.js", "// Code generated by x. DO NOT EDIT.\n" + GENERATED, "generated"),
        10: ("src/f.js", HAND.replace("// add", "// skip files that say DO NOT EDIT or @generated"), "authored"),
        11: (".\\notes.md", GENERATED, "authored"),
        12: (None, HAND, "authored"),
        13: ("src/x.min.js", None, "minified"),
        14: ("src/g.js", "", "authored"),
        16: ("src/deps/a.js", HAND, "authored"),
        17: ("p/app/external/api/a.js", HAND, "authored"),
        18: ("p/deps/a.js", HAND, "authored"),
        19: ("packages/p/deps/oak/lib/a.js", HAND, "vendored"),
        20: ("src/i.js", "\n".join(GENERATED.split("\n")[:19]), "authored"),
        15: ("src/h.js", HAND + "const table = [1, 2, 3, 4, 5, 6, 7, 8];\nconst key = '" + "x" * 200 + "';\n" + HAND, "authored"),
    }
    rows = [(i, p, D) for i, (p, _, _) in files.items()] + [(1, "src/old.min.js", None), (2, "src/b.js", D), (None, "x", D)]
    table = spark.createDataFrame(rows, "file_id long, path string, indexed_at timestamp_ntz")
    chunks = spark.createDataFrame([(i, i * 10, c, 1) for i, (_, c, _) in files.items()] + [(2, 20, GENERATED, 1), (99, 990, MINIFIED, 1), (None, 5, HAND, 1)], "file_id long, chunk_id long, content string, lines int")
    got = {r.file_id: r.origin for r in authored.file_origins(table, chunks).collect()}
    assert got == {i: o for i, (_, _, o) in files.items()}
    assert {r.file_id for r in authored.foreign_files(authored.file_origins(table, chunks)).collect()} == {i for i, (_, _, o) in files.items() if o != "authored"}
    assert authored.file_origins(table.limit(0), chunks.limit(0)).count() == 0


FOREIGN = [
    "/*! lunarheath v0.4.8 | (c) lunarheath contributors | permissive licence */\n",
    "// Vendored from upstream fallowridge 8.13.6; local changes marked below.\n",
    "\n// Third-party: keenheath 3.1.7. Imported as is, do not reformat.\n",
    "// bundled copy of windypier (2.13.0) so that installs need no network\n",
    "// Copied verbatim from the hazellathe project, release 7.16.4.\n// See THIRD_PARTY_NOTICES for its licence.\n",
    "/*!\n * some.js v3.6.0\n * Copyright some contributors\n * Released under the X license\n */\n",
]
OWN = [
    "// Loads modules vendored from upstream 1.2.3 and third-party: x 1.0 code.\n",
    "const a = 1;\n// Vendored from upstream fallowridge 8.13.6; local changes marked below.\n",
    "const s = '// Vendored from upstream x 1.2.3';\n",
    "// Copyright the authors of this project, under its licence.\n",
]


def test_third_party_notices(spark):
    texts = [t + HAND for t in FOREIGN + OWN]
    paths = [(i, f"src/f{i}.js", D) for i in range(len(texts))] + [(50, "src/late.js", D), (51, "notes/a.md", D), (52, "src/zero.js", D)]
    rows = [(i, i * 10, t, 1) for i, t in enumerate(texts)] + [(50, 500, HAND, 1), (50, 501, FOREIGN[1] + HAND, 40), (51, 510, "# Third-party: x 1.0.0", 1)]
    rows += [(52, 520, HAND, 0), (52, 521, FOREIGN[0] + HAND, 1)]
    files = spark.createDataFrame(paths, "file_id long, path string, indexed_at timestamp_ntz")
    chunks = spark.createDataFrame(rows, "file_id long, chunk_id long, content string, start_line int")
    got = {r.file_id for r in authored.file_origins(files, chunks).filter("origin = 'vendored'").collect()}
    assert got == {*range(len(FOREIGN)), 52}


@pytest.mark.parametrize("text", ["", "\n", "'", "\"", "/*", "`", "x" * 100_000, "\x00", "#", "日本語"])
def test_lexer_takes_anything(text):
    assert len(authored.lex_counts(text)) == len(authored.COUNTS) + 1


EN = ["The reader keeps the entries in memory.", "Please run the search again and attach the log.", "This folder must exist before you start the index.", "Nothing else was touched by the change."]
DE = ["Der Leser behält die Einträge im Speicher.", "Bitte die Suche noch einmal ausführen und das Protokoll anhängen.", "Dieser Ordner muss vor dem Start vorhanden sein.", "Sonst wurde durch die Änderung nichts angefasst."]
FR = ["Le lecteur garde les entrées en mémoire.", "Merci de relancer la recherche et de joindre le journal.", "Ce dossier doit exister avant de commencer l'index.", "Rien d'autre n'a été touché par ce changement."]


def test_languages(spark):
    made = [(i * 10 + k, " ".join(part[k:] + part[:k]) + "\n" + part[k], code) for i, (part, code) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr")] * 5) for k in range(4)]
    cases = {
        1000: (" ".join(EN), "de", {"en"}),
        1001: (" ".join(DE), " DE-at ", set()),
        1002: (" ".join(FR), None, {"fr"}),
        1003: (" ".join(EN) + "\n\n" + " ".join(FR), "en", {"en", "fr"}),
        1004: (None, "en", set()),
        1005: ("", None, set()),
        1006: (" \n\t", "xx", set()),
        1007: ("```\nlet x = 1;\n```\n`code`", "en", set()),
        1008: (" ".join(EN) + "\n```\n" + " ".join(FR) * 3 + "\n```", "English", set()),
        1009: (" ".join(DE).upper(), "unknown", {"de"}),
        1010: (" ".join(EN), "sv", {"en"}),
    }
    rows = made + [(i, t, lang) for i, (t, lang, _) in cases.items()] + [(1000, " ".join(EN), "de")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, letters int")
    codes = spark.createDataFrame([("en", "English"), ("de", "German"), ("fr", "French"), ("en", "English")], "lang_code string, lang_name string")
    wrong = {(r.doc_id, r.lang_code) for r in languages.wrong_labels(docs, codes).collect()}
    assert wrong == {(i, code) for i, (_, _, held) in cases.items() for code in held}
    stretches = languages.language_stretches(docs, codes).filter("doc_id = 1003").orderBy("start").collect()
    assert [r.lang_code for r in stretches] == ["en", "fr"] and all(0.9 < r.confidence <= 1 for r in stretches)
    assert stretches[0].end <= stretches[1].start <= len(" ".join(EN)) + 3
    assert languages.wrong_labels(docs.limit(0), codes).count() == 0


def test_held_out_accuracy():
    trees = languages.fit_trees([("en", " ".join(EN[:3])), ("de", " ".join(DE[:3])), ("fr", " ".join(FR[:3]))])
    best = trees.code_lengths([p.lower() for p in (EN[3], DE[3], FR[3])]).argmin(1)
    assert [trees.names[b] for b in best] == ["en", "de", "fr"]


def test_code_lengths_are_probabilities():
    trees = languages.ContextTrees({"x": ["abcabc", "abd"], "y": ["zzz"]})
    given = [c for c in range(256)]
    total = sum(2.0 ** -(trees.code_lengths(["ab" + chr(c)]) - trees.code_lengths(["ab" + chr(c)]) * 0)[0][0] for c in given if c < 128)
    assert 0 < total <= 1
