"""The corpus queries and their SQL."""

from . import ann, bpe, grading, language_id, license_scan, line_rules, mixing, near_dedup, substring_dedup, tool_chat

QUERIES = {
    "op1_line_rules": line_rules.op1_line_rules,
    "op2_ordinal_quality": grading.op2_ordinal_quality,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_rotated_codes": ann.op7_rotated_codes,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_tool_chat": tool_chat.op9_tool_chat,
    "op10_language_id": language_id.op10_language_id,
}
ORACLES = {
    "op1_line_rules": line_rules.OP1_SQL,
    "op3_license_scan": license_scan.OP3_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op6_near_dedup": near_dedup.OP6_SQL,
    "op7_rotated_codes": ann.OP7_SQL,
    "op9_tool_chat": tool_chat.OP9_SQL,
}
