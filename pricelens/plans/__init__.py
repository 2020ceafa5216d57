"""Business plans: fact, marts, scores, diagnostics, profiling, quality, dashboard."""
