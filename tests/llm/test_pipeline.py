import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from kgspark.llm import bpe, decontaminate, pii, quality_rules
from tests.llm.conftest import prose
from tests.llm.test_jaccard_join import brute, edited


def test_stages_equal_their_operators_by_brute_force(spark, docs, tmp_path):
    import random

    rng = random.Random(2)
    items = [prose(700 + i, 40) for i in range(4)]
    base = [prose(i, 60 + i) for i in range(20)]
    texts = base + [edited(t, rng, 1) for t in base[:8]] + base[:3] + [prose(50 + i, 50) + "\n" + items[i] for i in range(4)] + [f"{prose(80 + i, 40)}\nmail ab.{i}1@mail.example.com now please answer." for i in range(5)] + [None, "", "a | b | c | " * 20, "word " * 50, base[19] + "\nHome | News | Sport | About"]
    table = docs(texts)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    clean = {r.doc_id: r.clean_text for r in quality_rules.clean(table).collect() if r.kept}
    least = {i: c for i, _, c in brute(list(clean), list(clean.values()))}
    kept = {i: t for i, t in clean.items() if least[i] == i}
    bench = decontaminate.Benchmark(list(enumerate(items)))
    leaks = {list(kept)[d] for d, *_ in bench.pairs(list(kept.values()), 0.5)}
    assert leaks and len(kept) < len(clean) < len(texts)
    kept = {i: t for i, t in kept.items() if i not in leaks}
    assert rows.keys() == kept.keys()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in kept.items():
        ids = [int.from_bytes(rows[i].token_ids[k : k + 4], "little") for k in range(0, len(rows[i].token_ids), 4)]
        decoded = library.decode(ids, skip_special_tokens=False)
        assert ids == library.encode(decoded, add_special_tokens=False).ids and len(ids) == rows[i].n_tokens
        assert ("@" not in text and decoded == text) or (len(decoded) == len(text) and decoded != text and decoded.split("mail ")[0] == text.split("mail ")[0])


def test_stage_columns(spark, docs, tmp_path):
    spark.createDataFrame([(1, prose(9, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = docs([prose(1, 60), None, prose(2, 60)], [1, None, 2])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).columns == table.columns
    empty = docs([])
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, str(tmp_path))
        assert empty_out.count() == 0
    assert bpe.PATTERN and pii.PATTERNS
