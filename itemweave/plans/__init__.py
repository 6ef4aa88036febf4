"""Plan building blocks: shared storage, distributed numbering and the level-wise loop."""
