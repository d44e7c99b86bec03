"""One sentence for each code, made from the numbers of a finding.

Results carry codes and numbers; the sentence is for readers and states these numbers, nothing else.
"""

from __future__ import annotations

SENTENCES = {
    # distribution
    "zero_variance": "{n:,} values, all equal to {value:.6g}",
    "heavy_skew": "skewness {skew:.2f}: mean {mean:.6g} against median {median:.6g}",
    "moderate_skew": "skewness {skew:.2f}, mean {mean:.6g}, median {median:.6g}",
    "large_sample": "{n:,} values make any deviation significant (p {pvalue:.2g})",
    "negative_mean": "the coefficient of variation is taken over |{mean:.6g}|",
    "single_value": "1 distinct value",
    "id_like": "{unique:,} distinct values in {n:,}",
    "single_category": "1 distinct label",
    "high_cardinality": "{unique:,} distinct labels",
    "small_sample": "{n:,} values",
    # outliers
    "z_on_skew": "skewness {skew:.2f} moves mean and deviation, on which z-scores rest",
    "z_above_mz": "{z:,} by z-score, {mz:,} by median deviation",
    "mz_only": "{mz:,} by median deviation, 0 by z-score",
    "iqr_on_skew": "skewness {skew:.2f}: {iqr:,} values of the long tail lie past a fence",
    "mad_zero": "the median deviation is 0, so it flags nothing",
    # correlation
    "pearson_spearman_gap": "Pearson {r:.2f}, Spearman {rho:.2f}",
    "severe_vif": "variance inflation {vif:.1f}, limit {limit}",
    "moderate_vif": "variance inflation {vif:.1f}, limit {limit}",
    "many_categories": "{unique:,} labels",
    "skewed_columns": "{count} columns with a skewness beyond 2",
    # target
    "unequal_variances": "{count} columns with a Levene p below {limit}",
    "small_classes": "{count:,} classes of fewer than {limit} rows",
    "skewed_target": "target skewness {skew:.2f}",
    # quality gate
    "rows": "{value:.0f} rows",
    "columns": "{value:.0f} columns",
    "missing": "missing share {value:.3f}",
    "duplicates": "share of repeated rows {value:.3f}",
    "text_only": "{value:.0f} columns, all of them text",
    "special_names": "{value:.0f} names with special characters",
    "mixed": "share of numbers {value:.3f}",
    # health audit
    "few_rows": "{rows:,} rows for {columns} columns",
    "joint_missing": "both missing in a share of {share:.3f}",
    "equal_columns": "equal in every row",
    "numbers_as_text": "share of numbers {share:.3f}",
    "dates_as_text": "share of dates {share:.3f}",
    "placeholders": "{count:,} placeholders, such as {examples}",
    "spellings": "{count:,} labels in several spellings, such as {examples}",
    "constant": "1 distinct value",
    "near_constant": "share of the top value {share:.3f}",
    "identifier": "{unique:,} distinct values in {n:,}",
    "many_labels": "{unique:,} distinct labels",
    "extreme": "share past the outer fence {share:.3f}",
    "near_duplicate": "r {r:.3f}",
    "inflated": "variance inflation {vif:.1f}",
    "target_missing": "missing share {share:.3f}",
    "leakage": "{method} {score:.3f}",
    "imbalance": "class {name} has a share of {share:.3f}",
    # summary
    "skewed": "skewness {size:.2f}",
    "strong_pair": "|r| {size:.2f}",
    "outliers": "share past a fence {size:.3f}",
    "repeated_rows": "{size:,.0f} repeated rows",
    "missing_share": "missing share {size:.3f}",
    "vif": "variance inflation {size:.1f}",
    "key_like": "share of distinct values {size:.3f}",
    "one_value": "1 distinct value",
}


def say(code: str, **numbers) -> str:
    return SENTENCES[code].format(**numbers)
