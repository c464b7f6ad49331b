"""What the cascade does before it scores."""

from keylingo.operators import decide as D
from keylingo.plans import decide_queries as Q

SF = "/root/testdata/sf0.001"


def test_tokens_that_a_rule_decides_are_not_scored(spark, monkeypatch):
    asked, score = [], D.scored_tokens
    monkeypatch.setattr(D, "scored_tokens", lambda tokens, *more, **named: asked.append(sorted(r["token"] for r in tokens.select("token").collect())) or score(tokens, *more, **named))
    tokens = spark.createDataFrame([("ghbdtn",), ("house",), ("Kept",), (None,), ("house",)], "token string")
    rules = spark.createDataFrame([("kept", "keepAsIs", None), ("house", "none", None), ("ghbdtn", "preferHypothesis", "ru_from_en")], "token string, action string, hyp string")
    made = {r["token"]: (r["path"], r["text"]) for r in D.route(tokens, Q.models(spark, SF), rules).collect()}
    assert asked == [["house"]]
    assert made["ghbdtn"] == ("rule_prefer", "привет") and made["Kept"] == ("rule_keep", "Kept")
    assert sorted(made) == ["Kept", "ghbdtn", "house"] and made["house"][1] == "house"
