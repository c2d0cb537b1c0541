"""Tunables of the engine. Names and defaults are fixed values of the log model."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Chunks
    chunk_max_entries: int = 10_000
    chunk_max_bytes: int = 5_000_000
    chunk_max_seconds: float = 60.0
    # Control loop
    tick_interval_sec: float = 10.0
    actions_per_tick_budget: int = 10
    builds_per_tick: int = 3
    # Index decisions
    dynamic_indexing: bool = True
    static_indexes: tuple[str, ...] = ()
    build_threshold_freq: int = 5
    min_temp_for_index: float = 0.3
    idle_drop_sec: float = 600.0
    cooldown_sec: float = 600.0
    min_roi: float = 0.1
    # Memory
    mem_pressure_drop: float = 0.7
    mem_pressure_high: float = 0.8
    mem_pressure_critical: float = 0.95
    max_memory_bytes: int = 512 * 1024 * 1024
    # Bursts
    burst_enter: float = 3.0
    burst_exit: float = 1.5
    burst_stability_n: int = 3
    # Metrics
    cms_d: int = 5
    cms_w: int = 1024
    topk_k: int = 20
    ema_alpha_chunk_temp: float = 0.1
    write_window_sec: int = 60
    decay_every_n_ticks: int = 30
    decay_factor: float = 0.5
    # Indexes
    bloom_fp_rate: float = 0.01
    skip_block_size: int = 100
    # Tiers
    dynamic_tiering: bool = True
    heavy_index_threshold: int = 100 * 1024
    disk_cost_factor: int = 100
    demote_threshold: float = 0.1
    demote_idle_sec: float = 90.0
    demote_grace_sec: float = 30.0
    promote_threshold: float = 0.5
    max_hot_chunks: int = 32
    # Events
    metric_tick_interval_sec: float = 2.0
