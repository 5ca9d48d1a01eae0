"""The trie self-join of all fingerprints in the pipeline's near copies."""

from turnloom.llm import near_copies


def test_fingerprints_within_two_bits_are_one_group(spark):
    # repeats count in a fingerprint and not in a set: fingerprints agree, Jaccard similarity is far below 0.8
    chorus = "one two three four five " * 200
    rows = [(1, chorus + "a b c d e f g h"), (2, chorus + "k l m n o p q r"), (3, "nothing like the other two texts at all"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.one_per_group(docs).collect()) == [1, 3, 4]
