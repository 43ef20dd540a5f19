"""Column builders: every function returns a pyspark Column (JVM-side, no Python per row)."""

from .distances import (  # noqa: F401
    cosine, cosine_arr, euclidean, euclidean_arr, manhattan, manhattan_arr,
    numeric_distance, register_distance, string_distance,
)
from .ip import ip_set_similarity, ip_similarity, ip_to_long, long_to_ip  # noqa: F401
from .render import render_centroid_line, render_element, render_point  # noqa: F401
from .scale import scale_interval, unscale_interval  # noqa: F401
from .strings import (  # noqa: F401
    levenshtein, longer_term, longest_term_agg, normalized_levenshtein, shorter_term, utf8_bytes,
)
from .vectors import (  # noqa: F401
    dot, norm, point_add, point_distance, point_div, point_magnitude, point_neg, point_sub,
    vec_abs, vec_add, vec_dim, vec_div, vec_max, vec_min, vec_sub, vec_sum, vec_zip, weighted_dot,
)
