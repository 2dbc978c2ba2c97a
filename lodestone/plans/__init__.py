"""Composite searches and the planner that turns a question into one."""
