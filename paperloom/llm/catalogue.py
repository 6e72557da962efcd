"""Queries of the numbered operators."""

from paperloom.llm import alignment, decontaminate, hard_negatives, language, length_histogram, lines, near_duplicates, neighbours, packing, quality, substrings, token_files, url_filter


def queries() -> dict:
    return {
        "op1_token_files": token_files.query,
        "op2_neighbours": neighbours.query,
        "op3_substring_dedup": substrings.query,
        "op4_decontaminate": decontaminate.query,
        "op5_quality": quality.query,
        "op6_line_dedup": lines.query,
        "op7_near_duplicates": near_duplicates.query,
        "op8_packing": packing.query,
        "op9_length_histogram": length_histogram.query,
        "op10_language": language.query,
        "op11_alignment": alignment.query,
        "op12_url_filter": url_filter.query,
        "op13_hard_negatives": hard_negatives.query,
    }


def oracle_sql() -> dict:
    return {
        "op3_substring_dedup": substrings.SQL,
        "op4_decontaminate": decontaminate.SQL,
        "op12_url_filter": url_filter.SQL,
    }
