"""Tables in and out, and stages that resume."""
