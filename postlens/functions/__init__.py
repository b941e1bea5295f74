"""Column expressions (JVM-side, codegen-friendly); no Python UDFs."""

from postlens.functions.text import (  # noqa: F401
    clean_text, epoch_to_timestamp, strip_urls, strip_disallowed, tokens,
)
from postlens.functions.labels import agreement, first_label  # noqa: F401
from postlens.functions.json import decode_json, encode_json  # noqa: F401
