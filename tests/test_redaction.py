"""Redaction of nested records by the names of fields and keys, and where it changed something."""

from __future__ import annotations

from oddsloom.functions.redaction import redacted


def test_sensitive_names_and_texts_at_any_depth(spark):
    schema = "id long, password string, token_id int, account struct<name:string,api_key:string,deep:struct<cookie:string,n:int>>, tags array<struct<note:string,secret:string>>, extra map<string,string>, by map<string,int>"
    rows = [
        (1, "x", 5, ("me", "k", ("c", 3)), [("Bearer abcdefghijklmnop", "s")], {"session": "z", "note": "in /home/me/x"}, {"token": 4, "n": 2}),
        (2, "", None, None, None, None, None),
    ]
    got = {r.id: r.asDict(recursive=True) for r in redacted(spark.createDataFrame(rows, schema)).collect()}
    one = got[1]
    assert one["password"] == one["token_id"] == one["account"]["api_key"] == one["account"]["deep"]["cookie"] == one["tags"][0]["secret"] == "[REDACTED]"
    assert one["account"]["name"] == "me" and one["account"]["deep"]["n"] == 3 and "abcdefgh" not in one["tags"][0]["note"]
    assert one["extra"] == {"session": "[REDACTED]", "note": "in [REDACTED_PATH]"} and one["by"] == {"n": 2}
    assert one["redactions"] == ["password", "token_id", "account.api_key", "account.deep.cookie", "tags", "extra", "by"]
    two = got[2]
    assert two["password"] == "" and two["token_id"] is None and two["account"] is None and two["redactions"] == []
