"""Key sources, model files, benchmark records."""
