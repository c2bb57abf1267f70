"""All settings of a run in one frozen dataclass."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from typing import ClassVar


@dataclass(frozen=True)
class Settings:
    # Input
    data_path: str = ""
    encoding: str | None = None
    # Column names and the literal of the default input layout.
    col_id: str = "申请号"
    col_year: str = "申请年份"
    col_type: str = "专利类型"
    col_title: str = "专利名称"
    col_fallback_date: str = "申请日"
    text_parts: tuple[str, ...] = ("专利名称", "摘要文本", "主权项内容")
    extra_cols: tuple[str, ...] = ("申请人", "申请人类型", "申请人地址", "申请人城市")
    keep_type: str | None = "发明授权"
    # Text
    tokenizer: str = "auto"
    stopword_paths: tuple[str, ...] = ()
    user_dict_path: str | None = None
    # Vocabulary and weights
    min_term_count: int = 20
    max_doc_freq_ratio: float = 0.5
    # Pruning. Lists of words of its own: stop words of the text are gone by then.
    prune_word_paths: tuple[str, ...] = ()
    df_ratio_threshold: float = 0.20
    top_df_percent: float = 0.002
    topk_terms_per_doc: int = 30
    use_filtered_vectors: bool = True
    # Similarity
    window_size: int = 5
    similarity_threshold: float = 0.05
    epsilon: float = 1e-8
    pair_strategy: str = "native"
    method_version: str = "v1"
    # Output
    artifacts_dir: str = "artifacts"
    final_csv: str = field(default="")
    export_json: bool = False
    export_csv: bool = False
    log_file: str = ""
    #: Years that a stage writes at once: what an interrupted run repeats at most.
    years_per_write: int = 8

    #: Settings that each stage depends on, beside those of the stages before it.
    STAGE_INPUTS: ClassVar[dict[str, tuple[str, ...]]] = {
        "tokens": ("data_path", "encoding", "col_id", "col_year", "col_type", "col_title", "col_fallback_date", "text_parts", "extra_cols", "keep_type", "tokenizer", "stopword_paths", "user_dict_path"),
        "vocab": ("min_term_count", "max_doc_freq_ratio"),
        "vectors": (),
        "vectors_filtered": ("prune_word_paths", "df_ratio_threshold", "top_df_percent", "topk_terms_per_doc"),
        "postings": ("use_filtered_vectors",),
        "pairs": ("window_size", "similarity_threshold", "pair_strategy", "method_version"),
        "bsfs": (),
        "final": ("epsilon",),
    }

    def stage_key(self, stage: str) -> str:
        """Hash of every setting that the stage or an earlier one reads."""
        names: list[str] = []
        for name, fields in self.STAGE_INPUTS.items():
            names += fields
            if name == stage:
                break
        values = asdict(self)
        return hashlib.sha256(json.dumps({k: values[k] for k in names}, sort_keys=True).encode()).hexdigest()[:16]
