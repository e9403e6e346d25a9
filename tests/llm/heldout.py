"""Sentences that share no wording with the labelled texts, and spans that look like text but aren't."""

HELD_OUT = {
    "en": """this function returns the number of items in the list
the parser keeps track of the current position while reading tokens
we should probably rename these variables to something more meaningful
only administrators are allowed to remove comments written by guests
compute the average temperature over the past seven days
returns true when both strings contain identical characters
please contact support if the problem persists after restarting
the first argument specifies how many workers will be started
converts a relative path into an absolute one
old browsers do not understand this attribute so we skip it
this class is responsible for drawing the player on screen
avoid calling it inside a tight loop because it allocates memory
when the battery is low the screen brightness gets reduced
subtract the discount before adding taxes to the total price
your session has expired and you were signed out
the cache should be invalidated whenever a product gets updated
nobody remembers why this check was added in the first place
sort customers by country and then by last name
walk up the directory tree looking for a configuration folder
it seems the upstream library silently ignores empty headers""",
    "de": """diese Funktion liefert die Anzahl der Elemente in der Liste
der Parser merkt sich beim Lesen die aktuelle Position
nur Administratoren dürfen Kommentare von Gästen entfernen
berechnet die durchschnittliche Temperatur der letzten sieben Tage
bitte wenden Sie sich an den Support falls das Problem bestehen bleibt
das erste Argument gibt an wie viele Prozesse gestartet werden
wandelt einen relativen Pfad in einen absoluten um
ältere Browser verstehen dieses Attribut nicht
diese Klasse zeichnet den Spieler auf den Bildschirm
bei schwachem Akku wird die Helligkeit verringert
der Rabatt wird vor der Steuer vom Gesamtpreis abgezogen
Ihre Sitzung ist abgelaufen und Sie wurden abgemeldet
der Zwischenspeicher muss geleert werden sobald sich ein Produkt ändert
niemand weiß mehr warum diese Prüfung eingebaut wurde
Kunden nach Land und anschließend nach Nachname ordnen
sucht in den übergeordneten Ordnern nach einer Konfiguration
die Bibliothek ignoriert leere Kopfzeilen stillschweigend
sollte eigentlich schneller sein als die alte Variante
hier fehlt noch eine vernünftige Behandlung von Ausnahmen
gibt wahr zurück wenn beide Zeichenketten übereinstimmen""",
    "fr": """cette fonction renvoie le nombre d'éléments de la liste
l'analyseur mémorise la position courante pendant la lecture
seuls les administrateurs peuvent supprimer les commentaires des invités
calcule la température moyenne des sept derniers jours
contactez le support si le problème persiste après le redémarrage
le premier argument indique combien de processus seront lancés
convertit un chemin relatif en chemin absolu
les vieux navigateurs ne comprennent pas cet attribut
cette classe dessine le joueur à l'écran
la luminosité diminue lorsque la batterie est faible
la remise est déduite du prix total avant les taxes
votre session a expiré et vous avez été déconnecté
le cache doit être vidé dès qu'un produit est mis à jour
personne ne se souvient pourquoi ce contrôle a été ajouté
trier les clients par pays puis par nom de famille
remonte les dossiers à la recherche d'une configuration
la bibliothèque ignore silencieusement les champs vides
devrait être plus rapide que l'ancienne variante
il manque encore une gestion correcte des exceptions
renvoie vrai quand les deux chaînes sont identiques""",
    "es": """esta función devuelve el número de elementos de la lista
el analizador recuerda la posición actual durante la lectura
solo los administradores pueden eliminar comentarios de invitados
calcula la temperatura media de los últimos siete días
póngase en contacto con soporte si el problema continúa
el primer argumento indica cuántos procesos se iniciarán
convierte una ruta relativa en una absoluta
los navegadores viejos no entienden este atributo
esta clase dibuja al jugador en la pantalla
el brillo se reduce cuando queda poca batería
el descuento se resta del precio total antes de impuestos
su sesión ha caducado y hemos cerrado su cuenta
la caché debe vaciarse cuando se actualiza un producto
nadie recuerda por qué se añadió esta comprobación
ordenar los clientes por país y después por apellido
sube por los directorios buscando una carpeta de configuración
la biblioteca ignora en silencio las cabeceras vacías
debería ser más rápido que la variante antigua
todavía falta un manejo correcto de las excepciones
devuelve verdadero si ambas cadenas coinciden""",
    "pt": """esta função retorna a quantidade de elementos da lista
o analisador guarda a posição atual durante a leitura
somente administradores podem remover comentários de convidados
calcula a temperatura média dos últimos sete dias
entre em contato com o suporte caso o problema continue
o primeiro argumento indica quantos processos serão iniciados
converte um caminho relativo em absoluto para o sistema
navegadores antigos não entendem este atributo
esta classe desenha o jogador na tela
o brilho é reduzido quando a bateria está fraca
o desconto é subtraído do preço total antes dos impostos
sua sessão expirou e você foi desconectado
o cache deve ser limpo sempre que um produto for atualizado
ninguém lembra por que esta verificação foi adicionada
ordenar os clientes por país e depois pelo sobrenome
procura nas pastas acima uma pasta de configuração
a biblioteca ignora silenciosamente os cabeçalhos vazios
deveria ser mais rápido do que a variante antiga
ainda falta um tratamento correto das exceções
devolve verdadeiro quando ambas as cadeias coincidem""",
    "it": """questa funzione restituisce il numero di elementi della lista
il parser ricorda la posizione corrente durante la lettura
solo gli amministratori possono rimuovere i commenti degli ospiti
calcola la temperatura media degli ultimi sette giorni
contattare l'assistenza se il problema persiste dopo il riavvio
il primo argomento indica quanti processi saranno avviati
converte un percorso relativo in uno assoluto
i vecchi browser non capiscono questo attributo
questa classe disegna il giocatore sullo schermo
la luminosità viene ridotta quando la batteria è scarica
lo sconto viene sottratto dal prezzo totale prima delle tasse
la sessione è scaduta e sei stato disconnesso
la cache deve essere svuotata quando cambia un prodotto
nessuno ricorda perché questo controllo fu aggiunto
ordina i clienti per paese e poi per cognome
risale le cartelle cercando una configurazione adatta
la libreria ignora silenziosamente le intestazioni vuote
dovrebbe essere più veloce della vecchia variante
manca ancora una gestione corretta delle eccezioni
restituisce vero se le due stringhe coincidono""",
    "nl": """deze functie geeft het aantal elementen in de lijst terug
de parser onthoudt tijdens het lezen de huidige positie
alleen beheerders mogen reacties van gasten verwijderen
berekent de gemiddelde temperatuur van de afgelopen zeven dagen
neem contact op met de helpdesk als het probleem blijft bestaan
het eerste argument bepaalt hoeveel processen er worden gestart
zet een relatief pad om in een absoluut pad
oude browsers begrijpen dit attribuut niet
deze klasse tekent de speler op het scherm
bij een lage accu wordt de helderheid verminderd
de korting wordt voor de belasting van de totaalprijs afgetrokken
uw sessie is verlopen en u bent afgemeld
de cache moet worden geleegd zodra een product wijzigt
niemand weet nog waarom deze controle is toegevoegd
sorteer klanten op land en vervolgens op achternaam
zoekt in de bovenliggende mappen naar een configuratie
de bibliotheek negeert stilzwijgend lege velden
zou sneller moeten zijn dan de oude variant
hier ontbreekt nog een goede afhandeling van uitzonderingen
geeft waar terug wanneer beide teksten overeenkomen""",
    "pl": """ta funkcja zwraca liczbę elementów na liście
parser zapamiętuje bieżącą pozycję podczas czytania
tylko administratorzy mogą usuwać komentarze gości
oblicza średnią temperaturę z ostatnich siedmiu dni
skontaktuj się z pomocą techniczną jeśli problem nadal występuje
pierwszy argument określa ile procesów zostanie uruchomionych
zamienia ścieżkę względną na bezwzględną i sprawdza ją
starsze przeglądarki nie rozumieją tego atrybutu
ta klasa rysuje gracza na ekranie
przy słabej baterii jasność ekranu jest zmniejszana
rabat jest odejmowany od ceny przed podatkiem
twoja sesja wygasła i nastąpiło wylogowanie
pamięć podręczną należy wyczyścić gdy produkt się zmieni
nikt nie pamięta dlaczego dodano to sprawdzenie
posortuj klientów według kraju a potem nazwiska
szuka konfiguracji w folderach nadrzędnych aż do korzenia
biblioteka po cichu pomija puste nagłówki
powinno być szybsze niż stary wariant
nadal brakuje poprawnej obsługi wyjątków w tym miejscu
zwraca prawdę gdy oba napisy są takie same""",
    "ru": """эта функция возвращает количество элементов списка
парсер запоминает текущую позицию во время чтения
только администраторы могут удалять комментарии гостей
вычисляет среднюю температуру за последние семь дней
обратитесь в поддержку если проблема сохраняется
первый аргумент задаёт число запускаемых процессов
преобразует относительный путь в абсолютный для системы
старые браузеры не понимают этот атрибут
этот класс рисует игрока на экране
при слабой батарее яркость экрана уменьшается
скидка вычитается из общей цены до налога
ваша сессия истекла и вы вышли из системы
кэш необходимо очистить когда товар обновляется
никто не помнит зачем добавили эту проверку
отсортировать клиентов по стране а затем по фамилии
поднимается по каталогам в поисках конфигурации
библиотека молча игнорирует пустые заголовки
должно быть быстрее чем прежний вариант
здесь ещё не хватает обработки исключений
возвращает истину если обе строки совпадают""",
    "tr": """bu fonksiyon listedeki eleman sayısını döndürür
ayrıştırıcı okurken geçerli konumu hatırlar
misafir yorumlarını sadece yöneticiler kaldırabilir
son yedi günün ortalama sıcaklığını hesaplar
sorun devam ederse lütfen destek ekibiyle iletişime geçin
ilk argüman kaç sürecin başlatılacağını belirler
göreli bir yolu mutlak bir yola çevirir
eski tarayıcılar bu özelliği anlamaz
bu sınıf oyuncuyu ekrana çizer ve günceller
pil azaldığında ekran parlaklığı düşürülür
indirim vergiden önce toplam fiyattan çıkarılır
oturumunuzun süresi doldu ve çıkış yapıldı
bir ürün güncellendiğinde önbellek temizlenmelidir
bu denetimin neden eklendiğini kimse hatırlamıyor
müşterileri ülkeye ve ardından soyadına göre sırala
yapılandırma klasörünü üst dizinlerde arar
kütüphane boş başlıkları sessizce yok sayar
eski seçenekten daha hızlı olması gerekir
burada hâlâ düzgün bir istisna yönetimi eksik
iki metin aynıysa doğru değerini verir""",
    "ja": """この関数はリスト内の項目数を返す
解析器は読み取り中の現在位置を記憶しています
ゲストの書き込みを消せるのは管理者だけである
過去七日間の平均気温を計算する
再起動しても直らないときは窓口に連絡してください
第一引数で起動する作業者の数を指定する
相対パスを絶対パスに変換する処理
古いブラウザはこの属性を理解しません
このクラスは画面にプレイヤーを描画する
電池が少なくなると画面を暗くする
税を加える前に合計金額から割引を引く
有効期限が切れたのでログアウトしました
商品を更新したらキャッシュを消去すること
なぜこの確認が追加されたか誰も覚えていない
顧客を国別に並べてから姓で整列する
設定フォルダーを探して上の階層へ進む
このライブラリは空のヘッダーを無視する
以前の方法より速いはずである
例外の処理がまだ十分ではありません
二つの文字列が一致すれば真を返す""",
    "zh": """此函数返回列表中元素的数量
解析器在读取时记住当前位置
只有管理员可以删除访客的评论
计算过去七天的平均温度
如果重启后问题仍然存在请联系客服
第一个参数指定要启动多少个进程
把相对路径转换成绝对路径
旧浏览器不理解这个属性所以跳过
这个类负责在屏幕上绘制玩家
电量不足时降低屏幕亮度
加税之前从总价中减去折扣
您的会话已过期并且已被注销
产品更新后应当清空缓存
没有人记得为什么加了这个检查
先按国家再按姓氏对客户排序
沿着目录向上寻找配置文件夹
这个库会悄悄忽略空的标题
应该比以前的方案更快一些
这里还缺少合适的异常处理
两个字符串相同时返回真值""",
    "ko": """이 함수는 목록에 있는 항목의 개수를 반환한다
구문 분석기는 읽는 동안 현재 위치를 기억한다
관리자만 손님의 댓글을 지울 수 있다
지난 칠 일 동안의 평균 기온을 계산한다
재시작해도 해결되지 않으면 고객 지원에 문의하세요
첫째 인수는 시작할 작업자 수를 정한다
상대 경로를 절대 경로로 바꾸는 함수
오래된 브라우저는 이 속성을 이해하지 못한다
이 클래스는 화면에 플레이어를 그린다
배터리가 부족하면 화면 밝기를 낮춘다
세금을 더하기 전에 총액에서 할인을 뺀다
세션이 만료되어 자동으로 로그아웃 되었습니다
상품이 갱신되면 캐시를 꼭 비워야 한다
왜 이 검사가 추가되었는지 아무도 기억하지 못한다
고객을 나라별로 나눈 뒤 성으로 정렬한다
설정 폴더를 찾아 상위 디렉터리로 올라간다
라이브러리는 빈 헤더를 조용히 무시한다
이전 방식보다 더 빨라야 할 것이다
예외를 처리하는 코드가 아직 많이 부족하다
두 문자열이 서로 일치하면 참을 돌려준다""",
}
CODE_LIKE = """select name email from users where active order by created
SELECT count(*) FROM orders WHERE status = 'open' GROUP BY region
select a.id b.name from accounts a inner join branches b on a.branch = b.id
insert into logs values now info started null
update users set active where id in select user from banned
delete from sessions where expires before now
flex flex-col items-center justify-between gap-2 rounded-lg
btn btn-danger btn-lg float-right disabled hidden
text-center text-muted small border-top pt-3 mb-0
container mx-auto max-w-lg bg-gray-100 shadow-md
id name email phone address city country zip
width height depth weight color size
first last middle prefix suffix title
red green blue yellow orange purple black white
admin editor viewer owner guest moderator
monday tuesday wednesday thursday friday saturday sunday
user password host port database schema
left right top bottom center middle
north south east west up down
GET POST PUT PATCH DELETE HEAD OPTIONS
return this.items.filter(x => x.active).map(x => x.id)
if (user.isAdmin && !user.locked) return true;
for (let i = 0; i < rows.length; i++) { total += rows[i] }
while not queue.empty(): item = queue.get()
int main(int argc, char **argv) { return 0; }
var result = compute(a, b) or default
const double pi = 3.14 static final long max
public static void main string args throws exception
import os sys json math random
from collections import defaultdict Counter OrderedDict namedtuple
try catch finally throw raise except
def get self key default none return value
struct node int value struct node next
let mut count = 0 fn push self item
grep -rn pattern src lib tests docs
docker run --rm -it -v data app
git checkout -b feature origin main
cp mv rm ls cat echo cd
npm install react redux axios lodash webpack
usr local bin share lib etc
src lib app test docs build dist
json xml csv yaml toml ini parquet
utf-8 latin-1 ascii utf-16 big5 gbk
application json text html image png
alpha beta gamma delta epsilon zeta
foo bar baz qux quux corge
lorem ipsum dolor sit amet consectetur
true false null undefined nan infinity
int float double char long short byte
Mozilla Gecko Chrome Safari Edge Opera
jan feb mar apr may jun jul aug
usd eur gbp jpy chf cad aud
tcp udp icmp http https ftp ssh
aes rsa sha md hmac pbkdf bcrypt
create index idx on users using btree
drop table if exists temp cascade
alter table orders add column note text
else if elif switch case default break
yyyy mm dd hh mm ss
cat dog bird fish horse cow""".split("\n")
#: Sentences that no margin was chosen by.
FRESH = {
    "en": """Ensure that the directory exists before writing anything into it
this makes the whole thing about twice as slow, sorry
returns an array containing every prime below the given limit
the user clicked on cancel so we do nothing here
remember to close the stream once you are finished
maps each country code to its official currency
deprecated since version three, please migrate soon
the password must contain at least eight characters
fails silently when the network is unreachable
we need a better name for this variable""",
    "de": """Stellt sicher, dass der Ordner vor dem Schreiben existiert
dadurch wird das Ganze leider doppelt so langsam
der Benutzer hat auf Abbrechen geklickt, also passiert nichts
nicht vergessen, den Datenstrom am Ende zu schließen
das Kennwort muss mindestens acht Zeichen lang sein
schlägt stillschweigend fehl, wenn das Netz nicht erreichbar ist
wir brauchen einen besseren Namen für diese Variable
ordnet jedem Länderkürzel die amtliche Währung zu""",
    "fr": """vérifie que le dossier existe avant d'y écrire quoi que ce soit
l'utilisateur a cliqué sur annuler, on ne fait donc rien
n'oubliez pas de fermer le flux quand vous avez fini
le mot de passe doit contenir au moins huit caractères
échoue en silence lorsque le réseau est injoignable
il nous faut un meilleur nom pour cette variable
associe chaque code de pays à sa monnaie officielle""",
    "es": """asegura que la carpeta exista antes de escribir en ella
el usuario pulsó cancelar, así que no hacemos nada
no olvide cerrar el flujo cuando haya terminado
la contraseña debe contener al menos ocho caracteres
necesitamos un nombre mejor para esta variable""",
    "it": """verifica che la cartella esista prima di scriverci qualcosa
l'utente ha premuto annulla, quindi non facciamo nulla
ricordarsi di chiudere il flusso alla fine
ci serve un nome migliore per questa variabile""",
    "pt": """garante que a pasta existe antes de escrever nela
o usuário clicou em cancelar, então não fazemos nada
a senha deve conter pelo menos oito caracteres""",
    "nl": """zorgt ervoor dat de map bestaat voordat er iets in wordt geschreven
de gebruiker klikte op annuleren dus we doen niets
we hebben een betere naam nodig voor deze variabele""",
    "pl": """upewnij się, że katalog istnieje przed zapisem czegokolwiek
użytkownik kliknął anuluj, więc nic nie robimy
potrzebujemy lepszej nazwy dla tej zmiennej""",
    "tr": """yazmadan önce klasörün var olduğundan emin olur
kullanıcı iptal düğmesine bastı, bu yüzden bir şey yapmıyoruz
bu değişken için daha iyi bir isim lazım""",
    "ru": """убеждается, что папка существует перед записью
пользователь нажал отмену, поэтому мы ничего не делаем
нам нужно лучшее имя для этой переменной""",
}
