"""Plan-level building blocks: session settings, global ranking, the canonical sales model."""
