"""QR codes in pictures, where a reader (cv2) is installed; elsewhere nothing looks, and says so."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .mail import images

MOST_IMAGES = 8


def available() -> bool:
    try:
        import cv2  # noqa: F401
    except ImportError:
        return False
    return True


def payloads(raw: bytes | None) -> list[str] | None:
    """Distinct payloads of a message's pictures in order; None if there is no reader."""
    if not available():
        return None
    import cv2
    import numpy as np

    reader, found = cv2.QRCodeDetector(), {}
    for data in images(raw)[:MOST_IMAGES]:
        picture = cv2.imdecode(np.frombuffer(data, np.uint8), cv2.IMREAD_COLOR)
        if picture is None:
            continue
        ok, texts, *_ = reader.detectAndDecodeMulti(picture)
        for text in texts if ok else [reader.detectAndDecode(picture)[0]]:
            if text:
                found[text] = None
    return list(found)


def payloads_of(raw: Column | str) -> Column:
    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([payloads(b) for b in x], dtype=object)

    return run(raw)
