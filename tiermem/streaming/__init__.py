"""The memory as a stateful streaming operator."""
