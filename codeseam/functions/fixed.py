"""Words, prefixes, patterns and numbers that results depend on."""

# Modifier bits (Java class-file flags; default, sealed and non-sealed beyond them) and words, in order.
MODIFIERS = (
    (0x0001, "public"), (0x0004, "protected"), (0x0002, "private"), (0x0008, "static"), (0x0010, "final"), (0x0400, "abstract"),
    (0x0020, "synchronized"), (0x0100, "native"), (0x10000, "default"), (0x0800, "strictfp"), (0x0080, "transient"), (0x0040, "volatile"),
    (0x10000000, "sealed"), (0x4000000, "non-sealed"),
)

# Packages that count as external.
EXTERNAL_PREFIXES = ("java.", "javax.", "sun.", "com.sun.", "jdk.", "org.w3c.", "org.xml.")

# Relevance of an import candidate's package, first match wins; "=" the package itself, "^" a prefix.
IMPORT_RELEVANCE = (
    ("=", "java.util", 100), ("^", "java.util.", 95),
    ("=", "java.io", 90), ("^", "java.io.", 85),
    ("=", "java.nio.file", 88), ("^", "java.nio.", 82),
    ("=", "java.lang", 80), ("^", "java.time", 85), ("^", "java.math", 75), ("^", "java.", 70), ("^", "javax.", 65),
    ("^", "org.springframework.", 60), ("^", "org.junit.", 60), ("^", "org.mockito.", 55), ("^", "org.slf4j.", 55),
    ("^", "jakarta.", 50), ("^", "org.", 45), ("^", "com.", 40), ("^", "", 30),
)
FIX_RELEVANCE = (
    ("=", "java.util", 100), ("^", "java.util.", 95), ("=", "java.io", 90), ("^", "java.io.", 85), ("^", "java.nio.", 85),
    ("^", "java.time", 85), ("^", "java.", 70), ("^", "javax.", 65), ("^", "org.springframework.", 60), ("^", "org.junit.", 60), ("^", "", 40),
)

# Reflective methods.
REFLECTION_METHODS = (
    ("java.lang.Class", "forName"), ("java.lang.Class", "getMethod"), ("java.lang.Class", "getDeclaredMethod"),
    ("java.lang.Class", "getMethods"), ("java.lang.Class", "getDeclaredMethods"), ("java.lang.Class", "getField"),
    ("java.lang.Class", "getDeclaredField"), ("java.lang.Class", "getFields"), ("java.lang.Class", "getDeclaredFields"),
    ("java.lang.Class", "getConstructor"), ("java.lang.Class", "getDeclaredConstructor"), ("java.lang.Class", "getConstructors"),
    ("java.lang.Class", "getDeclaredConstructors"), ("java.lang.Class", "newInstance"), ("java.lang.reflect.Method", "invoke"),
    ("java.lang.reflect.Field", "get"), ("java.lang.reflect.Field", "set"), ("java.lang.reflect.Constructor", "newInstance"),
)

# Annotations of injected components, by category.
DI_ANNOTATIONS = (
    ("component", "org.springframework.stereotype.Component"), ("component", "org.springframework.stereotype.Service"),
    ("component", "org.springframework.stereotype.Repository"), ("component", "org.springframework.stereotype.Controller"),
    ("component", "org.springframework.web.bind.annotation.RestController"),
    ("configuration", "org.springframework.context.annotation.Configuration"),
    ("bean", "org.springframework.context.annotation.Bean"),
    ("injection", "org.springframework.beans.factory.annotation.Autowired"), ("injection", "javax.inject.Inject"),
    ("injection", "jakarta.inject.Inject"),
)

# Route annotations and their verbs.
SPRING_PACKAGE = "org.springframework.web.bind.annotation."
SPRING_VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH")  # GetMapping ... PatchMapping
JAXRS_PACKAGES = ("jakarta.ws.rs.", "javax.ws.rs.")
JAXRS_VERBS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH")

# Persistence annotations.
JPA_PACKAGES = ("jakarta.persistence.", "javax.persistence.")
JPA_RELATIONS = ("OneToMany", "ManyToOne", "OneToOne", "ManyToMany")

# Test annotations by simple name, and those that disable.
TEST_ANNOTATIONS = ("Test", "ParameterizedTest", "RepeatedTest", "TestFactory", "TestTemplate")
DISABLED_ANNOTATIONS = ("Disabled", "Ignore")

# Words that no new name may be.
RESERVED_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final "
    "finally float for goto if implements import instanceof int interface long native new package private protected public "
    "return short static strictfp super switch synchronized this throw throws transient try void volatile while true false "
    "null var yield record sealed permits non-sealed".split()
)

# Folders that a scan skips, build files and the order in which they decide the build system.
SKIPPED_FOLDERS = ("target", "build", "bin", ".git")
SKIPPED_PREFIX = "bazel-"
BUILD_SKIPPED_FOLDERS = (*SKIPPED_FOLDERS, "src", "node_modules")
BUILD_SYSTEMS = (
    ("MAVEN", ("pom.xml",)), ("GRADLE", ("build.gradle", "build.gradle.kts")), ("BAZEL", ("MODULE.bazel", "WORKSPACE", "WORKSPACE.bazel")),
)
BUILD_FILES = (
    "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "MODULE.bazel", "WORKSPACE",
    "WORKSPACE.bazel", "BUILD", "BUILD.bazel",
)

# Closeable classes of the platform, by full name.
CLOSEABLE = (
    "java.io.Closeable", "java.lang.AutoCloseable", "java.io.InputStream", "java.io.OutputStream", "java.io.Reader", "java.io.Writer",
    "java.io.FileInputStream", "java.io.FileOutputStream", "java.io.BufferedInputStream", "java.io.BufferedOutputStream",
    "java.io.FileReader", "java.io.FileWriter", "java.io.BufferedReader", "java.io.BufferedWriter", "java.io.InputStreamReader",
    "java.io.OutputStreamWriter", "java.io.PrintWriter", "java.io.PrintStream", "java.io.StringReader", "java.io.StringWriter",
    "java.io.ByteArrayInputStream", "java.io.ByteArrayOutputStream", "java.io.DataInputStream", "java.io.DataOutputStream",
    "java.io.ObjectInputStream", "java.io.ObjectOutputStream", "java.io.RandomAccessFile", "java.util.Scanner", "java.util.Formatter",
    "java.util.zip.ZipFile", "java.util.zip.ZipInputStream", "java.util.zip.ZipOutputStream", "java.util.zip.GZIPInputStream",
    "java.util.zip.GZIPOutputStream", "java.util.jar.JarFile", "java.net.Socket", "java.net.ServerSocket", "java.net.URLClassLoader",
)

# The methods that every class has.
OBJECT_METHODS = ("equals", "hashCode", "toString", "getClass", "notify", "notifyAll", "wait", "clone", "finalize")

# Checked exceptions of the platform, by simple name.
CHECKED_EXCEPTIONS = (
    "Exception", "Throwable", "IOException", "FileNotFoundException", "EOFException", "UnsupportedEncodingException", "MalformedURLException", "URISyntaxException",
    "SocketException", "UnknownHostException", "InterruptedException", "ExecutionException", "TimeoutException", "ClassNotFoundException", "CloneNotSupportedException",
    "InstantiationException", "IllegalAccessException", "NoSuchFieldException", "NoSuchMethodException", "InvocationTargetException", "ReflectiveOperationException",
    "SQLException", "ParseException", "GeneralSecurityException", "NoSuchAlgorithmException", "ParserConfigurationException", "SAXException", "TransformerException",
)

# Folders of sources, and those that builds write generated sources to (a star is any folder).
SOURCE_LAYOUTS = ("src/main/java", "src/test/java", "src/main/kotlin", "src/test/kotlin", "src/integrationTest/java", "src/it/java")
GENERATED_LAYOUTS = (
    "target/generated-sources/*", "target/generated-test-sources/*",
    "build/generated/sources/*/main/java", "build/generated/sources/*/test/java", "build/generated/sources/*/java/main", "build/generated/sources/*/java/test",
)

# Fixed value: the entry of a jar that registers annotation processors.
PROCESSOR_SERVICE = "META-INF/services/javax.annotation.processing.Processor"
