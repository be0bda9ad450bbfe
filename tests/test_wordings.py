import pytest

from ledgerspark.functions.text import asks_for


@pytest.mark.parametrize(
    ("text", "asks"),
    [
        ("Check it and then upload the result.", True),
        ("Do not run upload.", False),
        ("Please do  not upload yet", False),
        ("don't trigger the upload", False),
        ("no upload today", False),
        ("finish without upload", False),
        ("the upload was not executed", False),
        ("upload should be not run", False),
        ("upload not done; upload now", True),
        ("uploads are fine", False),
        ("不要执行上传", False),
        ("禁止 上传", False),
        ("上传不做", False),
        ("请上传结果", True),
    ],
)
def test_wordings(spark, text, asks):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(asks_for(frame["t"]).alias("a")).first()["a"] is asks
