"""Readers and writers."""

from .readers import attach_embeddings, read_generations, read_messages, read_preferences, read_prompts, read_sft, read_singletons
from .writers import dump_generations, step_metrics_sink, write_json_records, write_singletons, write_training_parquet

__all__ = [
    "attach_embeddings", "read_generations", "read_messages", "read_preferences", "read_prompts", "read_sft", "read_singletons",
    "dump_generations", "step_metrics_sink", "write_json_records", "write_singletons", "write_training_parquet",
]
