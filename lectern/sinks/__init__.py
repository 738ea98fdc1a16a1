"""Writers of the file formats that the jobs put out."""
