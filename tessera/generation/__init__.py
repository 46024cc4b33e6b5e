"""Generation by a pluggable model client, tool calls, episodes and tasks."""
