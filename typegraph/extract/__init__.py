"""From C# source text to one fragment of graph rows per file."""
