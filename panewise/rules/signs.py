"""Signs: for a rule, characters of which every match holds one at least.

A text without them is spared the rule's hints; tests/test_signs.py derives each from its pattern.
"""

SIGNS = {
    **dict.fromkeys((
        "misc_storage", "misc_random", "misc_hash", "orm_prisma", "orm_knex", "orm_typeorm", "orm_mongo",
        "orm_driver", "orm_supabase", "xss_angular", "xss_docwrite", "xss_eval", "xss_function",
        "xss_adjacent", "xss_timer", "xss_postmessage",
    ), "("),
    **dict.fromkeys(("misc_sourcemap", "misc_password", "xss_vue", "xss_innerhtml", "acc_forced_role"), "="),
    **dict.fromkeys(("misc_http", "misc_staging", "misc_admin_route"), "/"),
    **dict.fromkeys(("misc_debug", "misc_tls", "xss_react", "acc_bypass_flag", "acc_role"), ":="),
    "acc_constant": "_",
    "acc_permission": "\"'",
}
#: Characters that a hint may hold and most prose does not.
HINT_SIGNS = "-_/"
#: The same as SIGNS for the content rules, by name and evidence.
CONTENT_SIGNS = {
    **dict.fromkeys((
        ("Generator", "meta generator"), ("React", "React.version"), ("Vue.js", "Vue.version"),
        ("Angular", "ng-version"), ("AngularJS", "angular.version"), ("Alpine.js", "alpine"),
        ("Ember.js", "Ember.VERSION"), ("Backbone.js", "Backbone.VERSION"),
        ("jQuery", "jQuery.fn.jquery"), ("Three.js", "THREE.REVISION"),
    ), "="),
    **dict.fromkeys((
        ("React", "package manifest"), ("Next.js", "package manifest"), ("Vue.js", "package manifest"),
    ), "\""),
    **dict.fromkeys((
        ("React", "react runtime marker"), ("Gatsby", "gatsby runtime"), ("Vue.js", "vue runtime marker"),
        ("Solid.js", "solid runtime"), ("Astro", "astro assets"),
    ), "-_"),
    **dict.fromkeys((
        ("Next.js", "/_next/ assets"), ("Vite", "vite assets"), ("Magento", "magento paths"),
    ), "/_"),
    **dict.fromkeys((("Remix", "remix runtime"), ("Nuxt", "nuxt runtime"), ("SvelteKit", "sveltekit assets")), "_"),
    **dict.fromkeys((("Create React App", "CRA bundle layout"), ("jQuery", "filename"), ("Bootstrap", "banner")), "/"),
    **dict.fromkeys((("jQuery UI", "filename"), ("Ruby on Rails", "rails marker")), "-"),
    ("Preact", "preact"): ":=",
    ("htmx", "htmx"): "/=",
    ("WooCommerce", "woocommerce"): "-/",
    ("Laravel", "laravel marker"): "\"/_",
}
