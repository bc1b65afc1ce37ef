"""Drivers that compose operators: scratch tables, fixpoint loops, the assembly plan."""
