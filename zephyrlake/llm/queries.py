"""The operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from zephyrlake.llm.chat import OP9_SQL, op9_chat_format
from zephyrlake.llm.decontaminate import OP5_SQL, op5_decontaminate
from zephyrlake.llm.licenses import op2_license_scan
from zephyrlake.llm.line_dedup import OP8_SQL, op8_line_dedup
from zephyrlake.llm.media import OP1_SQL, op1_media
from zephyrlake.llm.near_dedup import OP4_SQL, op4_near_dedup
from zephyrlake.llm.pieces import op10_sentencepiece
from zephyrlake.llm.shards import OP6_SQL, op6_sharding
from zephyrlake.llm.toxicity import op7_toxicity
from zephyrlake.llm.url_graph import OP3_SQL, op3_url_filter

_ALL = (
    op1_media, op2_license_scan, op3_url_filter, op4_near_dedup, op5_decontaminate, op6_sharding, op7_toxicity, op8_line_dedup,
    op9_chat_format, op10_sentencepiece
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {
    "op1_media": OP1_SQL,
    "op3_url_filter": OP3_SQL, "op4_near_dedup": OP4_SQL, "op5_decontaminate": OP5_SQL, "op6_sharding": OP6_SQL, "op8_line_dedup": OP8_SQL,
    "op9_chat_format": OP9_SQL
}
