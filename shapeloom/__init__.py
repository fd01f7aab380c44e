"""JSON shaping and composition as DataFrame plans."""
